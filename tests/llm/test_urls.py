from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinetable.llm import urls
from kinetable.llm.queries import SITE_RULES

SCHEMA = "page_id long, url string, html string, words string, train boolean"


def plain_split(run, counts, total):
    """All cuts of a run, the cheapest first, then the one whose words begin first from the end."""
    unknown = math.log(total + 1)
    best = {0: (0.0, ())}
    for end in range(1, len(run) + 1):
        options = []
        for begin in range(end):
            word = run[begin:end]
            cost = math.log(total + 1) - math.log(counts[word]) if word in counts else unknown + 2.3 * len(word)
            options.append((best[begin][0] + cost, begin))
        low = min(c for c, _ in options)
        begin = min(b for c, b in options if c <= low + 1e-9)
        best[end] = low, (*best[begin][1], run[begin:end])
    return best[len(run)]


def brute(pages, listed=urls.LISTED):
    """Probability of every page, by loops over all of them."""
    text = lambda h: re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ", h or "").lower()
    counts = Counter(w for _, _, h, *_ in pages for w in re.findall(r"[^\W\d_]+", text(h)) if len(w) > 1) + Counter(listed)
    total = sum(counts.values())
    made = []
    for page, url, html, *_ in pages:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        words = [w for run in urls.host_runs(host) for w in plain_split(run, counts, total)[1]]
        fits = [r for r in SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        made.append((page, words, ["host " + w for w in words] + ["path " + t for t in urls.path_tokens(path)],
                     bool(set(words) & set(listed)), rule))
    known = [(f, bad) for _, _, f, bad, rule in made if bad or not (rule and rule.action == "block")]
    tokens = {kind: Counter(t for f, bad in known if bad is kind for t in f) for kind in (True, False)}
    kinds = len(tokens[True] | tokens[False])
    sums = {k: sum(v.values()) for k, v in tokens.items()}
    prior = math.log(1 + sum(b for _, b in known)) - math.log(1 + sum(not b for _, b in known))
    odds = {t: math.log((tokens[True][t] + 1) / (sums[True] + kinds)) - math.log((tokens[False][t] + 1) / (sums[False] + kinds))
            for t in tokens[True] | tokens[False]}
    out = {}
    for page, words, features, _, rule in made:
        p = 1 / (1 + math.exp(-(prior + sum(odds.get(f, 0) for f in features))))
        out[page] = words, p, rule.action if rule else "block" if p > 0.5 else "allow"
    return out


def corpus():
    random.seed(4)
    good, bad = ["daily", "news", "garden", "house", "river", "stone"], ["royal", "jackpot", "casino", "poker", "spin"]
    rows = []
    for i in range(160):
        names = bad if i % 4 == 0 else good
        host = "".join(random.sample(names, 2)) + random.choice([".com", ".org", ".net"])
        words = random.choices(names if i % 5 else good + bad, k=12) + ["therapist"] * (i % 3)
        rows.append((i, f"http://{host}/{random.choice(['en', 'de', 'fr', 'win'])}/{i}", f"<p>{' '.join(words)}</p><script>zz</script>", "w", True))
    return rows + [(900, None, None, None, None), (901, "http://onlinepoker.info", "", "", True), (902, "http://xn--ü/É/É?x", "ü É", "", False)]


def test_like_brute_force(spark):
    rows = corpus()
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, SCHEMA), SITE_RULES, ["page_id", "words"]).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for page, (words, p, verdict) in want.items():
        assert math.isclose(got[page].bad_probability, p, abs_tol=1e-6) and got[page].verdict == verdict, page
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_segments_like_all_cuts():
    random.seed(6)
    for _ in range(200):
        counts = {"".join(random.choices("ab", k=random.randint(1, 5))): random.randint(1, 50) for _ in range(8)}
        run = "".join(random.choices("abc", k=random.randint(0, 14)))
        total = sum(counts.values())
        words = urls.Segmenter(counts).split(run)
        cost = lambda ws: sum(math.log(total + 1) - math.log(counts[w]) if w in counts else math.log(total + 1) + 2.3 * len(w) for w in ws)
        assert "".join(words) == run and math.isclose(cost(words), plain_split(run, counts, total)[0], abs_tol=1e-9)


def test_every_word_counts_however_rare_and_long(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    rows = [(i, f"http://w{i}.com", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(i * 100, i * 100 + 100)), "", True)
            for i in range(60)]
    rows += [(99, f"http://{long}wordaaa.com/", long, "", True), (100, "http://bestviagrashop.com", "best shop", "", True),
             (101, "http://" + "q" * 3000 + ".com", "", "", True)]
    got = {r.page_id: r.words for r in urls.judged(spark.createDataFrame(rows, SCHEMA), SITE_RULES, ["page_id"]).collect()}
    assert got[99] == [long, "wordaaa"] and got[100] == ["best", "viagra", "shop"] and got[101] == ["q" * 3000]


def test_a_host_without_a_listed_word_is_learned_from_other_pages(spark):
    rows = [(i, f"http://royaljackpot{'casino' if i < 20 else ''}.com/win", "royal jackpot casino", "", i < 20 or i >= 40) for i in range(30)]
    rows += [(100 + i, f"http://gardennews.com/{i}", "garden news", "", True) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in urls.judged(df, SITE_RULES, ["page_id"], train=F.col("train")).collect()}
    held_out = [i for i in range(20, 30)]
    assert all(not set(got[i].words) & set(urls.LISTED) and got[i].verdict == "block" for i in held_out)
    assert all(got[100 + i].verdict == "allow" for i in range(60))


@pytest.mark.parametrize("count", [0, 1])
def test_repeats_and_empty_tables(spark, count):
    row = (None, "http://a.com/x", None, None, None)
    got = urls.judged(spark.createDataFrame([row, row][:2 * count], SCHEMA), SITE_RULES, ["page_id"]).collect()
    assert len(got) == 2 * count and len({tuple(map(str, r)) for r in got}) == count

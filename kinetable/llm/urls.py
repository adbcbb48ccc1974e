"""URL filters: rules on host and path, and a learned verdict for the rest.

Host names are split into words: at signs first, then each run of letters by the
most likely sequence of words (unigram Viterbi), with word counts from the text
of all pages. A multinomial naive Bayes model scores host words and path tokens.
It learns from the pages themselves: one with a listed word among its host words
counts as bad, the others as good but for those that a rule blocks. So words that
keep such company are learned with the listed ones, and block hosts without these.

Nothing is cut to the most frequent: counts and odds are tables. The distinct runs
of letters meet the counts of their parts in a join, distinct hosts and paths the
odds of their tokens, and pages the two sums. Sums are whole numbers, so reruns agree.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and gets the verdict of the prior; a null html has no words; a host or
path of any length is split, a word in it being as long as a host label (63) at most
or the whole run; of equally likely splits the one whose last word begins first is
taken; a probability of just the threshold allows; rows that repeat get equal
results; columns of any other name are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_texts
from kinetable.settings import checkpointed

# words that name what a filter is meant to keep out; the start of what the model learns
LISTED = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
LABEL = 63  # letters of a host label at most
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host with its subdomains and paths from ``path`` on."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _CAPITALS, _CAPITALS.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def best_rule(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, null if none does; of equally long ones the first by text."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def visible(html: Column) -> Column:
    return F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>|<[^>]*>", " ")


def word_counts(pages: DataFrame, html: str = "html", listed: tuple[str, ...] = LISTED) -> DataFrame:
    """``word`` and ``n``: how often words of two letters or more occur in the visible text of all pages.

    Listed words count once more, so that they are known whatever the pages say.
    """
    word = F.explode(F.split(F.lower(visible(F.col(f"`{html}`"))), "[^\\p{L}]+")).alias("word")
    own = pages.sparkSession.createDataFrame([(w,) for w in listed], "word string")
    return pages.select(word).where(F.length("word") >= 2).unionByName(own).groupBy("word").agg(F.count("*").alias("n"))


def split_runs(runs: DataFrame, counts: DataFrame, longest: int = LABEL) -> DataFrame:
    """``run`` and ``words``: distinct runs of letters split by the most likely sequence of words.

    A run meets the counts of its own parts only, all of up to ``longest`` letters and itself, so no task needs the
    whole vocabulary.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = F.expr(f"""concat(array(run), flatten(transform(sequence(0, length(run) - 1), i ->
        transform(sequence(2, greatest(2, least({longest}, length(run) - i))), k -> substring(run, i + 1, k)))))""")
    known = runs.select("run", F.explode(F.array_distinct(parts)).alias("word")).join(counts, "word")
    listed = known.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = runs.join(listed, "run", "left")

    def start():
        def work(columns):
            known, runs = columns
            out = []
            for run, have in zip(runs, known):
                out.append(Segmenter({h["word"]: h["n"] for h in have or ()}, longest=max(longest, len(run)), total=total).split(run))
            return [runs, out]
        return work

    return map_texts(rows, ["known", "run"], "run string, words array<string>", start)


@dataclass
class Segmenter:
    """Splits runs of letters into words by their counts; unknown words cost more the longer they are."""

    counts: dict[str, int]
    longest: int = LABEL
    memo: dict = field(default_factory=dict)
    total: int | None = None  # of all words, where ``counts`` has only some

    def __post_init__(self):
        total = (sum(self.counts.values()) if self.total is None else self.total) + 1
        self.cost = {w: math.log(total) - math.log(n) for w, n in self.counts.items()}
        self.unknown = math.log(total)

    def split(self, name: str) -> list[str]:
        if name not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[name] = self._viterbi(name)
        return self.memo[name]

    def _viterbi(self, name: str) -> list[str]:
        # unknown letters cost the same each and once a run, so of unknown words only those that begin
        # where it is cheapest so far have to be tried
        best, back = [0.0], [0]
        sizes = sorted({len(w) for w in self.cost if len(w) <= self.longest})
        cheapest, since = 0.0, 0
        for end in range(1, len(name) + 1):
            cost, begin = cheapest + self.unknown + 2.3 * end, since
            for size in sizes:
                if size > end:
                    break
                known = self.cost.get(name[end - size:end])
                if known is not None and (best[end - size] + known, end - size) < (cost, begin):
                    cost, begin = best[end - size] + known, end - size
            best.append(cost)
            back.append(begin)
            if cost - 2.3 * end < cheapest:
                cheapest, since = cost - 2.3 * end, end
        words, end = [], len(name)
        while end:
            words.append(name[back[end]:end])
            end = back[end]
        return words[::-1]


_LETTERS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"[^\W\d_]+|\d+")


def host_runs(host: str) -> list[str]:
    """Runs of letters of a host without the last label, which says where and not what."""
    return _LETTERS.findall(host.rsplit(".", 1)[0] if "." in host else host)


def path_tokens(path: str) -> list[str]:
    """Words of a path in lower case; numbers are one token."""
    return ["0" if t[0].isdigit() else t.lower() for t in _TOKENS.findall(path)]


@dataclass(frozen=True)
class Bayes:
    """Log odds of bad against good: of the prior, of each known token, and of an unknown one."""

    prior: float
    odds: dict[str, float]

    def probability(self, features: list[str]) -> float:
        total = self.prior + sum(self.odds.get(f, 0.0) for f in features)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def token_odds(rows: DataFrame) -> tuple[float, DataFrame]:
    """Multinomial naive Bayes with add-one smoothing from ``features`` (array), ``bad`` (boolean) and ``n`` (rows alike):
    the log odds of the prior, and ``token`` with its ``odds`` for every token there is."""
    sizes = {r.bad: r.n for r in rows.groupBy("bad").agg(F.sum("n").alias("n")).collect()}
    counted = checkpointed(rows.select("bad", "n", F.explode("features").alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good")))
    bad, good, kinds = (x or 0 for x in counted.agg(F.sum("bad"), F.sum("good"), F.count("*")).first())
    odds = F.log((F.col("bad") + 1) / F.lit(float(bad + kinds))) - F.log((F.col("good") + 1) / F.lit(float(good + kinds)))
    return math.log(sizes.get(True, 0) + 1) - math.log(sizes.get(False, 0) + 1), counted.select("token", odds.alias("odds"))


def fit(rows: DataFrame) -> Bayes:
    """The same for a small table, as one object."""
    prior, odds = token_odds(rows.withColumn("n", F.lit(1)))
    return Bayes(prior, {r.token: r.odds for r in odds.collect()})


def _sums(features: DataFrame, key: str, odds: DataFrame) -> DataFrame:
    """``key`` and ``sum``, the log odds of its features; whole billionths, so that their order does not matter."""
    whole = F.round(F.col("odds") * 1_000_000_000).cast("long")
    return features.select(key, F.explode("features").alias("token")).join(odds, "token").groupBy(key).agg(F.sum(whole).alias("sum"))


def judged(
    pages: DataFrame, rules: list[Rule], keys: list[str], *, url: str = "url", html: str = "html",
    listed: tuple[str, ...] = LISTED, threshold: float = 0.5, train: Column | None = None,
) -> DataFrame:
    """``keys``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``words`` and ``bad_probability``.

    ``train`` is a condition on the pages the verdicts are learned from, by default all.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    action = best_rule(rules, F.col("host"), F.col("path"), lambda r: r.action)
    names = [f"__key_{k}" for k in keys]
    rows = checkpointed(pages.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], host.alias("host"), path.alias("path"),
        (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train")))

    def of_hosts():
        return lambda columns: [columns[0], [host_runs(h) for h in columns[0]]]

    def of_paths():
        return lambda columns: [columns[0], [path_tokens(p) for p in columns[0]]]

    hosts = checkpointed(map_texts(rows.select("host").distinct(), ["host"], "host string, runs array<string>", of_hosts))
    runs = hosts.select(F.explode("runs").alias("run")).distinct()
    split = split_runs(runs, checkpointed(word_counts(pages, html, listed)))
    placed = hosts.select("host", F.posexplode("runs").alias("at", "run")).join(split, "run").groupBy("host").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    hosts = checkpointed(hosts.select("host").join(placed, "host", "left").select(
        "host", F.coalesce("words", F.array().cast("array<string>")).alias("words")))
    paths = checkpointed(map_texts(rows.select("path").distinct(), ["path"], "path string, tokens array<string>", of_paths))

    # pages alike in host words, path tokens and label are counted together: the site, not the page, is the row
    bad_host = F.arrays_overlap("words", F.array(*[F.lit(w) for w in listed]))
    known = rows.where("train").join(hosts, "host").join(paths, "path").withColumn("action", action).select(
        F.concat(F.transform("words", lambda w: F.concat(F.lit("host "), w)),
                 F.transform("tokens", lambda t: F.concat(F.lit("path "), t))).alias("features"),
        bad_host.alias("bad"), "action")
    # what a rule blocks is no example of a good page
    known = known.where(F.col("bad") | F.coalesce(F.col("action") != "block", F.lit(True))).groupBy("features", "bad").agg(F.count("*").alias("n"))
    prior, odds = token_odds(known)
    odds = checkpointed(odds)
    named = lambda kind, column: F.transform(column, lambda t: F.concat(F.lit(f"{kind} "), t)).alias("features")
    host_sums = _sums(hosts.select("host", named("host", "words")), "host", odds).withColumnRenamed("sum", "host_sum")
    path_sums = _sums(paths.select("path", named("path", "tokens")), "path", odds).withColumnRenamed("sum", "path_sum")
    of_host = hosts.join(host_sums, "host", "left")
    scored = rows.join(of_host, "host").join(path_sums, "path", "left")
    total = F.lit(prior) + (F.coalesce("host_sum", F.lit(0)) + F.coalesce("path_sum", F.lit(0))) / 1_000_000_000
    scored = scored.withColumn("bad_probability", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total)))))
    learned = F.when(F.col("bad_probability") > threshold, "block").otherwise("allow")
    return scored.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], "host", "path",
        best_rule(rules, F.col("host"), F.col("path"), lambda r: r.text).alias("rule"),
        F.coalesce(action, learned).alias("verdict"), "words", "bad_probability")

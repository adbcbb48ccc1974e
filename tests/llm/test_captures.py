from __future__ import annotations

import glob
import gzip
import hashlib
import json
import random

import duckdb
import pytest

from kinetable.llm import captures, queries
from kinetable.llm.registry import CHECKS

SCHEMA = "page_id long, url string, html string, key string, bytes int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def made(spark, rows, tmp_path, **sizes):
    df = pages(spark, rows)
    return df, captures.write(df, str(tmp_path / "a"), **sizes)


def corpus():
    random.seed(12)
    rows = []
    for i in range(300):
        host = random.choice(["example.com", "a.example.com", "b.example.org", "EXAMPLE.net", "example.community", "x.y.z"])
        rows.append((i, f"http://{host}/{random.choice('pqr')}/{i % 40}?q={i % 3}#f", "<p>" + "é" * random.choice([0, 20, 60, 61, 200]) + "</p>"))
    return rows


def want(rows):
    out, first = [], {}
    known = [(p, u, (h or "").encode()) for p, u, h in rows]
    for page, _, data in known:
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    for page, _, data in known:
        refers = first.get(data) if first.get(data) != page else None
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_records_come_back_through_the_index(spark, tmp_path):
    rows = corpus()
    df, archive = made(spark, rows, tmp_path, lines=7, parts=3, roll=20_000)
    got = captures.captured(archive, df).collect()
    assert sorted(((r.id, r.bytes, r.digest, r.type, r.refers) for r in got), key=repr) == want(rows)
    text = {p: (h or "").encode() for p, _, h in rows}
    assert all(bytes(r.payload) == text[r.id] for r in got) and {r.url for r in got} == {u for _, u, _ in rows}
    assert len(archive.parts) > 1 and len(glob.glob(f"{archive.folder}/archive/*")) > 4


def test_files_are_plain_archives_and_a_sorted_index(spark, tmp_path):
    rows = corpus()
    _, archive = made(spark, rows, tmp_path, lines=7)
    seen = 0
    for name in glob.glob(f"{archive.folder}/archive/*"):
        data = gzip.open(name).read()
        while data:
            head = data.partition(b"\r\n\r\n")[0]
            assert head.startswith(b"WARC/1.1\r\n")
            size = len(head) + 4 + int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert data[size:size + 4] == b"\r\n\r\n"
            data, seen = data[size + 4:], seen + (b"WARC-Type: warcinfo" not in head)
    assert seen == len(rows)
    keys = []
    for part in archive.parts:
        with gzip.open(f"{archive.folder}/index/{part.split()[0]}") as lines:
            keys += [captures.place(*json.loads(x)[:2]) for x in lines]
    assert keys == sorted(keys) and len(keys) == len(rows)


def test_every_line_is_found_and_no_other(spark, tmp_path):
    rows = [(i % 5, f"http://h{i % 9}.org/", f"{i}") for i in range(90)] + [(None, None, None), (None, "x", ""), (3, "http://h3.org", "")]
    df, archive = made(spark, rows, tmp_path, lines=4, parts=4)
    keys = [(r.key, r.id) for r in df.select(captures.site_key(df.url).alias("key"), df.page_id.alias("id")).collect()]
    index = captures.Index(archive)
    for key, page in set(keys):
        assert len(list(index.at(key, page))) == keys.count((key, page))
    for key, page in [("", 1), ("org,h1)/", 5), ("org,h1)/", None), ("a", 0), ("zzz", 0)]:
        assert list(index.at(key, page)) == []


def test_one_page_over_many_blocks_and_parts(spark, tmp_path):
    df, archive = made(spark, [(1, "http://a.b/", "x")] * 60 + [(2, "http://a.b/", "y"), (0, "http://a.b/", "z")], tmp_path, lines=4, parts=5)
    assert len(archive.parts) > 2 and len(list(captures.Index(archive).at("b,a)/", 1))) == 60
    assert captures.captured(archive, df).count() == 62


def test_captures_of_hosts(spark, tmp_path):
    rows = corpus() + [(900, "http://u@example.com:80/x", "port"), (901, "http://example.comx/", "no")]
    _, archive = made(spark, rows, tmp_path, lines=3, parts=4)
    hosts = spark.createDataFrame([("example.com",), ("Example.com",), ("none.org",), (None,)], "h string")
    got = {r.id for r in captures.of_hosts(archive, hosts, "h").collect()}
    assert got == {p for p, u, _ in rows if u.split("/")[2].split("@")[-1].split(":")[0] in ("example.com", "a.example.com")}


def test_keys(spark):
    urls = {"http://WWW.Example.com/A?b#c": "com,example,www)/A?b", "https://u:p@a.b:8080?x": "b,a:8080)?x", "http://1.2.3.4/": "1.2.3.4)/",
            "about:blank#x": ")about:blank", "": ")", None: "", "http://a.b": "b,a)", "x://y\n.z/q://r": "z,y\n)/q://r"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.key for r in df.select("url", captures.site_key(df.url).alias("key")).collect()} == urls


def test_nulls_repeats_line_breaks_and_long_payloads(spark, tmp_path):
    big, long = "x" * 100, "y" * 3_000_000
    rows = [(None, None, None), (None, None, big), (None, "u", big), (4, "http://a\r\nb/", big), (4, "http://a\r\nb/", big), (4, "http://c/", big),
            (9, None, big), (5, "http://l/", long), (6, "http://l/", long), (7, "http://e/", ""), (8, "http://e/", "z" * 99),
            (10, "http://e/", "z" * 99), (None, "n", "q" * 200), (None, "m", "q" * 200), (-3, "http://neg/", "w" * 150), (11, None, "w" * 150)]
    df, archive = made(spark, rows, tmp_path, lines=2, parts=3)
    got = captures.captured(archive, df).collect()
    assert sorted(((r.id, r.bytes, r.digest, r.type, r.refers) for r in got), key=repr) == want(rows)
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest for r in got)


def test_a_damaged_archive_is_noticed(spark, tmp_path):
    data = captures.record(1, "u", b"text", hashlib.sha256(b"text").hexdigest(), None, None, None, "d")
    assert captures.parsed(data)[1] == b"text"
    with pytest.raises(ValueError):
        captures.parsed(data[:-6])


def test_empty_table(spark, tmp_path):
    df, archive = made(spark, [], tmp_path)
    assert archive.parts == () and captures.captured(archive, df).count() == 0
    assert captures.of_hosts(archive, spark.createDataFrame([("a",)], "h string"), "h").count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got = queries.QUERIES["op12_warc_captures"](spark, folder)
    result = db.execute(CHECKS["op12_warc_captures"])
    assert got.columns == [d[0] for d in result.description]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(result.fetchall(), key=repr)

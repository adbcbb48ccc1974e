"""The registered corpus queries, each a thin cover of one operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import (
    captures, density, dialogues, langid, licenses, mixing, phrases, pieces, rules, simhash, spellings, suffixes, urls,
)
from kinetable.llm.registry import QUERIES, query, read

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("documents")
def op2_simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(docs, ["doc_id"], order="doc_id")
    return found.select(
        "doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("documents", sql=rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS draw
           FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS z,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(z) OVER () AS total, row_number() OVER (ORDER BY 3 * z / w::DOUBLE, w, source) AS k FROM s),
a AS (SELECT *, coalesce(sum(3 * z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
c AS (SELECT min(k) AS cut FROM a WHERE held * w + 3 * z * free >= total * w),
v AS (SELECT held AS cut_held, free AS cut_free, cut FROM a, c WHERE k = cut),
t AS (SELECT source, z, CASE WHEN k < cut THEN (3 * z)::DOUBLE
             ELSE ((total - cut_held) * w)::BIGINT::DOUBLE / cut_free::DOUBLE END AS target FROM a, v),
j AS (SELECT doc_id, size, z::BIGINT AS source_size, target, d.source, draw,
             CASE WHEN z > 0 THEN floor(target / z::DOUBLE)::BIGINT ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM j)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN whole < 3
         AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM b
""")
def op6_mix_sources(docs: DataFrame) -> DataFrame:
    rows = mixing.mixed(docs, ["doc_id"])
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _distance(found: str, total: str, reference: str) -> str:
    log = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0.0 END)"
    p = f"(CASE WHEN {total} > 0 THEN {found}[i] / {total}::DOUBLE ELSE 0.0 END)"
    q = f"{reference}[i]"
    return (f"sqrt(greatest(list_sum(list_transform(range(1, len({found}) + 1), lambda i: "
            f"({log(p)} + {log(q)}) / 2 - {log(f'(({p} + {q}) / 2)')})), 0.0))")


@query("documents", sql=rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, {WORDS} AS w FROM documents),
p AS (SELECT rid, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT rid, i, w1, lead(w1) OVER n AS w2, lead(w1, 2) OVER n AS w3 FROM p WINDOW n AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS c FROM q WHERE w3 IS NOT NULL),
u AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM r, (VALUES (0), (1), (2)) AS k(k) WHERE c > 1 GROUP BY rid),
b AS (SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS dup_lines,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digits, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper_,
  length(regexp_replace(t, '[^.,;:!?"''()]+', '', 'g')) AS punct, w FROM d),
f AS (SELECT b.*, coalesce(u.n, 0)::BIGINT AS n_repeat_words,
  [digits, upper_, punct, n_symbols, word_chars - digits - upper_ - punct - n_symbols] AS classes,
  list_transform({_listed(rules.VOCABULARY)}, lambda v: len(list_filter(w, lambda x: x = v))) AS found
  FROM b LEFT JOIN u USING (rid)),
g AS (SELECT *, list_append(found, n_words - list_sum(found)) AS full_ FROM f),
refs AS (SELECT lang AS ref, list_transform(range(1, 6), lambda i: cs[i] / list_sum(cs)::DOUBLE) AS c,
         list_transform(range(1, {len(rules.VOCABULARY) + 2}), lambda i: vs[i] / list_sum(vs)::DOUBLE) AS v FROM (
  SELECT lang, [{', '.join(f'sum(classes[{i}])' for i in range(1, 6))}] AS cs,
         [{', '.join(f'sum(full_[{i}])' for i in range(1, len(rules.VOCABULARY) + 2))}] AS vs
  FROM g WHERE n_words >= 50 AND lang IN ('de', 'en', 'es', 'fr') GROUP BY lang)),
m AS (SELECT rid, min({_distance('classes', 'word_chars', 'c')}) AS class_distance,
             min({_distance('full_', 'n_words', 'v')}) AS word_distance FROM g, refs GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND coalesce(class_distance, 0) <= 0.28 AND (n_words < 50 OR coalesce(word_distance, 0) <= 0.45) AS kept
FROM g LEFT JOIN m USING (rid)
""")
def op8_quality_rules(docs: DataFrame) -> DataFrame:
    return rules.quality_rules(docs, ["doc_id"]).drop("class_distance", "word_distance")


@query("documents")
def op3_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    cut = suffixes.cut_repeats(docs, order="doc_id", carry=["doc_id", "n_bytes"])
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("documents")
def op10_document_fingerprints(docs: DataFrame) -> DataFrame:
    return phrases.fingerprints_with_next(docs, order="doc_id").withColumnRenamed("id", "doc_id")


@query("documents")
def op1_language_id(docs: DataFrame) -> DataFrame:
    held_out = langid.fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    known = density.bounded(labels.where(langid.fold(F.col("doc_id"), 4) != 2).select("doc_id", "quality"), "doc_id")
    # a table of bounded size, so the texts are not moved to meet it
    model = density.fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    rows = density.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES["op7_quality_classifier"] = op7_quality_classifier


SITE_RULES = [
    urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


@query("pages")
def op4_url_filters(pages: DataFrame) -> DataFrame:
    return urls.judged(pages, SITE_RULES, ["page_id"])


@query("documents")
def op5_license_scan(docs: DataFrame) -> DataFrame:
    return licenses.scan(docs, ["doc_id"])


VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query("documents")
def op9_sentencepiece(docs: DataFrame) -> DataFrame:
    """The two best segmentations of every text, and whether they give the text again."""
    found = pieces.encoded(docs, ["doc_id"], path=VOCABULARY_FILE, verify=True, count=2)
    return found.withColumn("n_pieces", F.size("ids").cast("long"))


@query("documents")
def op11_spelling_variants(docs: DataFrame) -> DataFrame:
    return spellings.variants(spellings.vocabulary(spellings.misspelt_runs(docs)))


@query("pages", sql="""
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest),
j AS (SELECT d.*, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers FROM d LEFT JOIN f USING (digest))
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN refers IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers AS refers_to FROM j
""")
def op12_warc_captures(pages: DataFrame) -> DataFrame:
    """Pages written as records, and read back through the index."""
    archive = captures.write(pages, captures.new_folder(pages.sparkSession))
    rows = captures.captured(archive, pages, payloads=False)
    return rows.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


@query("conversations")
def op13_conversation_repair(rows: DataFrame) -> DataFrame:
    """Damaged conversations, their faults and cheapest repairs; those that lost all turns have nothing to say."""
    found = dialogues.repaired(dialogues.damaged(rows)).drop("turns").withColumnRenamed("conv_id", "found_id").withColumn("there", F.lit(True))
    ids = rows.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")) & F.col("there"), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

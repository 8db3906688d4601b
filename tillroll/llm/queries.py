"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    ann, decontam, langid, mixing, passages, quality, repeats, runs, simhash, tokens, urlfilter, warc, whitening)
from tillroll.llm.common import read

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _page(column: str) -> Column:
    return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def not_held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves another remainder than ``part``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts != part, F.lit(True))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a WARC archive and back."""
    found = warc.roundtrip(read(spark, sf_dir, "pages"))
    return found.select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        _page("refers_to").alias("refers_to"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 4 bits or fewer, over all documents."""
    found = simhash.simhash_clusters(read(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within its edit budget."""
    return decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five documents, predicts all."""
    docs = read(spark, sf_dir, "documents")
    held_out = ~not_held_out("doc_id", 5, 0)
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, extra={"held_out": held_out}).select(
        "doc_id", "held_out", "lang_pred", "score", F.col("lang").alias("lang_accepted"), "margin")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 100, against all rows."""
    found = ann.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled documents outside the held-out fold, scores all."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(not_held_out("doc_id", 4, 2)))
    columns = {"doc_id": F.col("doc_id"), "held_out": ~not_held_out("doc_id", 4, 2)}
    return quality.score(docs, model, columns=columns).withColumn(
        "predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at least once, no source more than twice."""
    dealt = mixing.mix(read(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "source", mixing.tokens_of(F.col("text")).alias("tokens"), "epoch", "place")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rule list."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, packed and written to shards in training order."""
    return tokens.materialise(read(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 100 bytes or more removed from every whole text."""
    cut = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about every tenth text repeats a part of itself to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    first = docs.select("doc_id", "text", h.alias("h")).withColumn("n", F.when(F.col("h") % 10 == 0, F.size(words)).otherwise(0))
    g = F.floor(F.col("h") / 10)
    at = first.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    cut = at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    part = F.slice(words, F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), tail), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 24 words and three periods or more in all documents."""
    found = runs.periodic_runs(planted_periods(read(spark, sf_dir, "documents")), min_length=24)
    # the greatest length / period, compared as fractions; the first of equal ones
    best = F.reduce("runs", F.element_at("runs", 1), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    found = found.withColumn("lines", lines).withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=8)


def op13_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller document holds, removed from every whole text."""
    cut = passages.remove_passages(read(spark, sf_dir, "documents"), width=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS least FROM p WHERE strlen(html) >= 100 GROUP BY digest)
SELECT page_id, strlen(html) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least < page_id THEN least END AS refers_to
FROM p LEFT JOIN first ON p.digest = first.digest AND strlen(html) >= 100
"""

OP8_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
       ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
best AS (
  SELECT n, max({'len': length(r.host) + length(r.path), 'rule': r.host || r.path, 'action': r.action}) AS b
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n)
SELECT p.page_id, p.host, p.path, best.b['rule'] AS rule, coalesce(best.b['action'], 'allow') AS verdict
FROM parts p LEFT JOIN best USING (n)
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
word AS (SELECT r, doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
wide AS (
  SELECT r, doc_id, w, i, CASE WHEN count(*) OVER ahead = 50 THEN string_agg(w, ' ') OVER ahead END AS s
  FROM word WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
least AS (SELECT s, min(doc_id) AS d FROM wide WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, w, i, coalesce(least.d < doc_id, false) AS gone FROM wide LEFT JOIN least USING (s)),
cut AS (
  SELECT r, w, i, bool_or(gone) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM cut GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_warc, op2_simhash, op3_decontamination, op4_language_id, op5_nearest, op6_quality, op7_mixing,
        op8_url_filter, op9_token_shards, op10_repeats, op11_periodic_runs, op12_whitening, op13_shared_passages)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op8_url_filter": OP8_SQL, "op13_shared_passages": OP13_SQL}

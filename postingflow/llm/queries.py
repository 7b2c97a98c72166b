"""Registered queries of the training-data operators: thin bindings that apply
an operator to its whole table and derive the digest columns from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import (decontaminate, html_extract, language_id, mixing, near_duplicates, periodic_runs, pieces,
               quality_rules, ranked_search, secrets, suffix_dedup, toxicity, window_dedup)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_secret_scan")
def op1(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    return found.select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count("random").alias("n_random"))


@_query("op2_substring_dedup", """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
least AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
  FROM win JOIN least USING (h) WHERE doc_id > owner),
lost AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, j: NOT coalesce(list_contains(ks, j), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
""")
def op2(spark, sf_dir):
    kept = window_dedup.strip_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2("kept", 256).alias("kept_sha256"))


_ALNUM_SQL = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@_query("op3_decontamination", f"""
WITH d AS (SELECT doc_id, {_ALNUM_SQL} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS m,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, i, item FROM win JOIN pat USING (m, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op3(spark, sf_dir):
    found = decontaminate.contaminated_words(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = decontaminate.hit_words(F.col("spans"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def domain_of(source):
    """The domain of a source of ``documents``: by its number (no number: web)."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1), F.lit("999999999"))
    return F.element_at(F.array(*map(F.lit, mixing.DOMAINS)),
                        F.coalesce(F.pmod(number.cast("int"), F.lit(len(mixing.DOMAINS))), F.lit(0)) + 1)


@_query("op4_mixing", mixing.ORACLE)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = mixing.mix(docs.select("doc_id", "text", "lang", "source", domain_of(F.col("source")).alias("domain")),
                       levels=("domain", "lang", "source"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("level_1").alias("domain"),
                        F.col("level_2").alias("lang"), F.col("level_3").alias("source"), "n_tokens", "epoch", "n_taken")


@_query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.train(docs, fold != 2)
    found = language_id.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"),
                        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")


@_query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    p = [F.get("p", F.lit(k)).alias(f"p_{c}") for k, c in enumerate(toxicity.CATEGORIES)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *p,
                        (F.element_at("p", -1) >= model.threshold).alias("toxic"))


@_query("op7_html_extraction")
def op7(spark, sf_dir):
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op8_suffix_dedup")
def op8(spark, sf_dir):
    kept = suffix_dedup.strip_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                       F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@_query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                        (F.col("node") == F.col("component")).alias("kept"))


@_query("op10_quality_rules", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, p FROM win GROUP BY doc_id, p HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 8)) AS k FROM win JOIN again USING (doc_id, p)) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, CAST(n_words < 20 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS BIGINT)
    + 4 * CAST(100 * n_symbols > 50 * n_words AS BIGINT)
    + 8 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines AS BIGINT)
    + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 20 * n_words AS BIGINT)
    + 64 * CAST(n_words >= 20 AND 100 * n_upper > 60 * word_chars AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM f
""")
def op10(spark, sf_dir):
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", (~quality_rules.passes(F.col("fail_bits"), "base-1")).alias("base_failed"),
        quality_rules.passes(F.col("fail_bits"), quality_rules.CURRENT).alias("kept"), "fail_bits")


@_query("op11_ranked_search", f"""
WITH d AS (SELECT doc_id, unnest({_ALNUM_SQL}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
q AS (SELECT DISTINCT item_id, unnest({_ALNUM_SQL}) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, total WHERE t IN (SELECT t FROM q) GROUP BY t, docs),
m AS (SELECT doc_id, 50 + (50 * n * docs) // words AS m FROM n, total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 50
""")
def op11(spark, sf_dir):
    found = ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@_query("op12_sentencepiece")
def op12(spark, sf_dir):
    found = pieces.encode(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs.select(
        "doc_id", periodic_runs.looped(F.col("text"), F.col("doc_id")).alias("text")))
    best = periodic_runs.strongest(F.col("runs"))
    part = lambda name: best[name].cast("long").alias(name)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        part("start"), part("length"), part("period"),
        F.floor(F.lit(1000).cast("long") * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))

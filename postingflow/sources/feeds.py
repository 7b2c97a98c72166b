"""Landed search-feed pages and detail documents.

Feeds are landed as JSON files (the HTTP client is not part of the engine).
Schemas are always given, never inferred, so a scan over millions of files
does not run an inference pass, and unknown fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def explode_pages(env: DataFrame) -> DataFrame:
    """Envelope frame (page, stellenangebote, _file) -> one raw record per posting.

    Keeps the array position.  An empty or null array ends the feed: pages
    after the first empty one of the same feed run are dropped, where a run
    is the folder the pages were landed in.  Pages are ordered by their
    number, pages without one by their file path.  The end per run is a small
    aggregate (one row per run), joined back to the pages.
    """
    order = F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.col("_file").alias("file"))
    env = env.withColumn("_run", F.regexp_extract("_file", "^(.*)/[^/]*$", 1)).withColumn("_ord", order)
    ends = (env.filter(F.coalesce(F.size("stellenangebote"), F.lit(-1)) <= 0)
               .groupBy("_run").agg(F.min("_ord").alias("_end")))
    live = (env.join(ends, "_run", "left")
               .filter(F.col("_end").isNull() | (F.col("_ord") < F.col("_end"))))
    return explode_records(live.withColumn("page", F.col("_ord.page")))


def explode_records(env: DataFrame) -> DataFrame:
    """Envelopes -> raw records, without the end-of-feed rule."""
    rec = env.select(F.coalesce("page", F.lit(0)).cast("long").alias("page"), "_file",
                     F.posexplode("stellenangebote").alias("pos", "r"))
    return rec.select(
        F.col("r.refnr").alias("refnr"),
        F.col("r.hashId").alias("hashId"),
        F.col("r.titel").alias("titel"),
        F.col("r.arbeitgeber").alias("arbeitgeber"),
        F.col("r.arbeitsort.ort").alias("ort"),
        F.col("page"),
        F.col("pos").cast("long").alias("pos"),
        F.to_json("r").alias("raw_json"),
        F.col("_file"),
    )


def read_search_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Read envelopes ``{"page": n, "stellenangebote": [...]}``.

    ``multi_line`` reads one pretty-printed envelope per file; otherwise one
    envelope per line.  The page number comes from the envelope, else from the
    last number in the file's name; pages of a run that have neither are taken
    in the order of their paths.
    """
    env = spark.read.schema(S.SEARCH_PAGE).option("multiLine", multi_line).json(path)
    return explode_pages(env.select(page_number(), "stellenangebote", F.col("_metadata.file_path").alias("_file")))


def page_number():
    """Page of an envelope: its own number, else the last one in the file name, else null."""
    named = F.regexp_extract(F.col("_metadata.file_name"), "([0-9]{1,18})[^0-9]*$", 1)
    return F.coalesce(F.col("page").cast("long"), F.nullif(named, F.lit("")).try_cast("long")).alias("page")


DETAIL_READ = T.StructType(list(S.RAW_DETAIL.fields) + [T.StructField("hashId", T.StringType())])


def read_details(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Detail documents, one per posting key.

    The lookup key is the document's ``hashId`` field when present, else the
    file name without extension (one file per key, as the detail endpoint
    serves them).  Lookup itself is a left join (J2), so a missing detail
    leaves the posting row in place.
    """
    d = (spark.read.schema(DETAIL_READ).option("multiLine", multi_line).json(path)
         .withColumn("_stem", F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1)))
    return d.select(F.coalesce("hashId", "_stem").alias("detail_key"),
                    *[F.col(f.name) for f in S.RAW_DETAIL.fields])

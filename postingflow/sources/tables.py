"""Table scans and sinks.

Stored posting tables are Parquet directories partitioned by a hash bucket
of the reference key.  An idempotent append reads the (bounded) list of
buckets present in the batch and filters the stored table on it, so the
anti join reads only those bucket directories instead of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .. import schemas as S
from ..operators.dedup import dedup_first, ref_bucket

#: Rows that one hash bucket of a stored table is meant to hold, and the least
#: number of buckets.
BUCKET_ROWS = 1_000_000
MIN_BUCKETS = 64


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S3: full scan of a stored table (Parquet); Catalyst prunes columns and
    pushes filters into the scan."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when nothing was written yet.  Any other
    failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def table_buckets(spark: SparkSession, path: str, batch: DataFrame, expected_rows: int | None) -> int:
    """Number of hash buckets of a stored table, kept beside it: chosen at the
    first append from the rows that are expected (or those of that batch)."""
    kept = try_read(spark, f"{path}/_properties")
    if kept is not None:
        return kept.agg(F.max("buckets")).first()[0]
    rows = expected_rows if expected_rows is not None else batch.count()
    buckets = max(MIN_BUCKETS, -(-rows // BUCKET_ROWS))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_properties")
    return buckets


def fresh_rows(batch: DataFrame, stored: DataFrame | None, key: str = "reference_id", order=("page", "pos")) -> DataFrame:
    """S4's rows to append: the first record of each key (D1) that is not
    stored yet (J1); ``stored`` is None for a table that does not exist."""
    first = dedup_first(batch, key, order)
    if stored is None:
        return first
    on = [c for c in ("ref_bucket", key) if c in stored.columns and c in first.columns]
    return first.join(stored.select(*on).distinct(), on, "left_anti")


def append_new(new_df: DataFrame, path: str, key: str = "reference_id",
               order=None, buckets: int | None = None, expected_rows: int | None = None) -> int:
    """Append only rows whose key is not stored yet; a rerun adds nothing.

    Returns the number of rows written.  The batch is deduplicated first
    (D1, in feed order), then anti-joined (J1) with the stored keys of the
    touched buckets.  The bucket count belongs to the table (``table_buckets``).
    """
    spark = new_df.sparkSession
    if order is None:
        order = tuple(c for c in ("page", "_file", "pos") if c in new_df.columns)
    if buckets is None:
        buckets = table_buckets(spark, path, new_df, expected_rows)
    batch = dedup_first(new_df, key, order).withColumn("ref_bucket", ref_bucket(F.col(key), buckets))
    batch = batch.drop(*[c for c in order if c in batch.columns and c not in S.POSTING.fieldNames()]).cache()
    stored = try_read(spark, path)
    fresh = batch
    if stored is not None:
        # the touched buckets are at most ``buckets`` small ints: a bounded
        # read that turns into a static partition filter on the stored table
        touched = [r[0] for r in batch.select("ref_bucket").distinct().collect()]
        stored = stored.filter(F.col("ref_bucket").isin(touched)).select("ref_bucket", key)
        fresh = batch.join(stored, ["ref_bucket", key], "left_anti")
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("ref_bucket").parquet(path)
    fresh.unpersist()
    batch.unpersist()
    return n


def listing_source():
    """Data source ``artifact_listing``: (path, length) of every file under ``path``.

    Spark's own file sources leave out files without content; this one lists
    the storage, so a length of 0 is kept.  A task lists one folder directly
    under ``path`` with all it holds, folder by folder (another one the files of
    ``path`` itself).  As in Spark's sources, names that start with ``_`` or
    ``.`` are hidden.  Storage is reached through Arrow's file systems (a path
    or a URI).  The classes are made here so that workers need no import.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.glob = options["path"], options.get("glob", "*")

        def _entries(self, fs, folder):
            from pyarrow.fs import FileSelector
            found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
            return [e for e in found if not e.base_name.startswith(("_", "."))]

        def _open(self):
            from pyarrow.fs import FileSystem
            return FileSystem.from_uri(self.path)

        def partitions(self):
            from pyarrow.fs import FileType
            fs, base = self._open()
            folders = [e.path for e in self._entries(fs, base) if e.type == FileType.Directory]
            return [InputPartition((base, False))] + [InputPartition((f, True)) for f in sorted(folders)]

        def read(self, partition):
            import fnmatch

            import pyarrow as pa
            from pyarrow.fs import FileType
            (first, deep), (fs, _) = partition.value, self._open()
            todo = [first]
            while todo:
                entries = self._entries(fs, todo.pop())
                files = [e for e in entries if e.type == FileType.File and fnmatch.fnmatchcase(e.base_name, self.glob)]
                if deep:
                    todo += [e.path for e in entries if e.type == FileType.Directory]
                if files:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([e.path for e in files]), pa.array([e.size for e in files], pa.int64())], ["path", "length"])

    class ArtifactListing(DataSource):
        @classmethod
        def name(cls):
            return "artifact_listing"

        def schema(self):
            return "path string, length long"

        def reader(self, schema):
            return Reader(self.options)

    return ArtifactListing


def list_artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of every file under ``path``, empty ones included.
    Paths come without scheme and host, as applications hold them."""
    spark.dataSource.register(listing_source())
    found = spark.read.format("artifact_listing").option("path", path).option("glob", glob).load()
    return found.select(plain_path(F.col("path")).alias("path"), "length")


def plain_path(c):
    """A path without URI scheme and host (``file:/a``, ``hdfs://host/a`` -> ``/a``)."""
    return F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "")


def progress_events(df: DataFrame, type_col: str = "type", message_col: str = "message",
                    time_col: str = "ts", keep=()) -> DataFrame:
    """One JSON progress event per row: {type, message, time HH:mm:ss};
    a null message becomes "" and carriage returns are dropped."""
    msg = F.replace(F.coalesce(F.col(message_col), F.lit("")), F.lit("\r"), F.lit(""))
    return df.select(*keep, F.to_json(F.struct(
        F.col(type_col).alias("type"), msg.alias("message"),
        F.date_format(time_col, "HH:mm:ss").alias("time"))).alias("json"))


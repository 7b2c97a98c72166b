"""Session settings and small planning helpers shared by every operator.

Nothing here executes data work; it only configures Spark so that Catalyst
and AQE can do theirs (runtime broadcast conversion, partition coalescing,
skew-join splitting).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry.  AQE re-plans joins from real
# shuffle sizes, so a join side that turns out small is broadcast at
# runtime and a skewed partition is split; nothing here forces a strategy.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Settings for the target cluster (~100 TB input, ~1000 executors); not used
# by the local tests.  Shuffle partitions start high and AQE coalesces them
# to ~256 MB each; scans split at 256 MB; a partition more than 5x the
# median (and above 1 GB) is split by the skew-join rule; runtime broadcast
# only below 64 MB of real size.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "postingflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session without the setting (tests) gets a scratch folder; a
    cluster must name one that all its machines share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="pf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one Arrow batch: rows that hold whole texts or packed blocks reach them
#: long before the limit of rows, and a Python worker holds two batches at a time.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about ``BATCH_BYTES`` in this session (a smaller setting stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # noqa: BLE001 - a Spark without this setting: batches are bounded by rows only
        return


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the Python path of the session's workers.

    Functions run by ``mapInPandas`` / ``applyInPandasWithState`` are pickled
    by reference to their module, so every worker must be able to import
    ``postingflow``.  The package is zipped once per application and handed
    to ``SparkContext.addPyFile``, which serves it to every executor (the
    same as ``spark-submit --py-files``); the zip is only a staging file.
    Python functions that need the package also get Arrow batches of bounded bytes.
    """
    bound_batches(spark)
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext (e.g. a remote session): nothing to ship
        return
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    stage = tempfile.mkdtemp(prefix="pf-pyfiles-")
    target = os.path.join(stage, "postingflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)

"""Session settings shared by library, tests and benchmarks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on: UTC dates (JS "today" is a UTC date), ANSI arithmetic, last-writer-wins
# map merging for JSON patches, AQE for runtime re-planning (partition coalescing, skew splitting, late
# broadcast conversion of sides whose runtime size turns out small).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "equipledger",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests / benchmarks. On a cluster, pass the cluster's own builder settings instead."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g")
         # checkpoint files of DataFrames that are gone are removed, so repeated batches do not pile up
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the library's SQL settings to an existing session (e.g. one the driver built)."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static confs cannot change on a running session; they are defaults only
            pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in ``spark.checkpoint.dir``.

    There is no fallback: a machine-local folder would be read by other executors as missing files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> str:
    """Points the context's checkpoints at the shared folder and returns it."""
    d = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_own_folder: ContextVar[str | None] = ContextVar("own_folder", default=None)


@contextmanager
def intermediates_dropped(spark: SparkSession) -> Iterator[None]:
    """What ``materialized`` writes within goes to a folder of its own, which is removed at the end: for a step whose outputs are
    all written by then."""
    folder = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    before = _own_folder.set(folder)
    try:
        yield
    finally:
        _own_folder.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read again with the same schema: columnar and compressed, so it
    takes a fraction of a ``checkpoint()``'s bytes, and readers take only the columns they need."""
    path = f"{_own_folder.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")      # ids are mostly digits, which it packs far better than the default
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Spark session settings that the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Only semantics and adaptive execution are set here. Sizing (executors, memory,
# shuffle partitions) belongs to the cluster that submits the job.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods over 8000 bytes: wide expressions (log parsing, rule
    # chains) run faster when such stages are split than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Top-N per key is limited below the shuffle up to this N (the timeline takes 10 000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Undecodable bytes in a log must not end a job over a fleet.
    "spark.sql.legacy.codingErrorAction": "true",
}


def build_session(app: str = "fleetlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution. ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def pin_utc(spark: SparkSession) -> SparkSession:
    """Epoch arithmetic on timestamps is only meaningful in one zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; survives the loss of executors.

    Only where the cluster names none (a single-machine run) is a folder made up, since a
    machine-local folder is not shared between executors.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for results of moderate size that several plans share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_STAGED: dict[str, list[str]] = {}
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def staged_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which belongs to the current scope."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(_SCOPE.get(), []).append(path)
    return path


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """A written Parquet table in the shared folder, for large results: later plans read
    only the columns they need. ``codec`` compresses it in another way than the session does."""
    spark = df.sparkSession
    path = staged_folder(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging_scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables staged inside belong to ``name``; those of the scope's last use are deleted first.

    For steps of a job that write their results: when the next step begins, nothing reads the
    intermediate tables of the one before any more.
    """
    drop_staged(spark, name)
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def drop_staged(spark: SparkSession, scope: str | None = None) -> int:
    """Deletes every table that ``stage`` has written in this driver, or in ``scope``; call it once the results that
    read them are written elsewhere. Gives the number of tables."""
    paths = [p for name in (list(_STAGED) if scope is None else [scope]) for p in _STAGED.pop(name, [])]
    conf = spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def release_shuffles(spark: SparkSession) -> None:
    """Deletes shuffle files of plans that nothing refers to any more: Spark does so when the driver's garbage is
    collected, which a long driver-side job may not do for hours."""
    gc.collect()
    spark._jvm.System.gc()

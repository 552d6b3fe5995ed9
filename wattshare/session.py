"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Recording a Python call site for every column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app_name: str = "wattshare", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    Partition counts are left to the cluster: AQE coalesces from whatever
    ``spark.sql.shuffle.partitions`` says.  ``conf`` keys use ``__`` for ``.``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one inside ``spark.sql.warehouse.dir``.

    Outside local mode a folder without a scheme or with ``file:`` is used only if it was named by
    ``spark.checkpoint.dir``, which vouches for its being shared.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None) or ""
    local = warehouse.startswith(("file:", "/")) or ":" not in warehouse
    if local and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{warehouse.rstrip('/')}/_staged"


#: Folders written by ``staged`` and not yet released, by session.
_STAGED: dict[str, list[str]] = {}


def _staged_by(spark: SparkSession) -> list[str]:
    return _STAGED.setdefault(spark._jsparkSession.sessionUUID(), [])


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete this session's staged tables, all or those after the first ``since``; call it when results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _staged_by(spark)
    while len(paths) > since:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def staging(spark: SparkSession):
    """Tables staged inside the block are deleted at its end: store or collect results within it."""
    before = len(_staged_by(spark))
    try:
        yield
    finally:
        release(spark, before)


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one reduced table feeds several branches: the readings are scanned once, every
    branch reads only the Parquet columns it needs, and a lost executor costs a re-read
    instead of a re-scan of the readings.  The table stays until ``release``, or the end of a ``staging`` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _staged_by(spark).append(path)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_tables(spark: SparkSession) -> int:
    """How many staged tables there are now, as ``release`` and ``staged_alone`` take it."""
    return len(_staged_by(spark))


def staged_alone(df: DataFrame, label: str, since: int) -> DataFrame:
    """``staged``, after which the tables staged after the first ``since`` go: nothing but ``df`` may be made of them."""
    spark = df.sparkSession
    kept = staged(df, label)
    path = _staged_by(spark).pop()
    release(spark, since)
    _staged_by(spark).append(path)
    return kept

"""Session helpers: a local test session and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_fallback_dir: str | None = None


def local_session(cores: int | str = "*", app: str = "waymark") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the session runs on one machine, as in tests, a folder of our own is used.
    """
    global _fallback_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="waymark-")
    return _fallback_dir


def application_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/waymark/{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{application_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Spark has no function for it that works on every store; where this one is missing, the table stays."""
    context = getattr(spark, "_jsc", None)
    if context is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A written table survives lost executors, keeps column pruning, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


#: Where ``materialise`` wrote the tables that are still in use.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` gave, once everything that follows from them is written."""
    for table in tables:
        _remove(table.sparkSession, _written.pop(table))

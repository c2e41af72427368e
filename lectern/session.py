"""Session settings, and lineage cutting through the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", app: str = "lectern", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one it hands out."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(scratch)
    return scratch


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/lectern-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage and survives executor loss.  Unlike an eager ``checkpoint()`` it computes
    the rows once, and the table's size is known to the planner that reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table read whose splits are fewer than the cores at hand, dealt over all of them before costly text work.

    A table of at least as many splits as cores (any large one) is left as it is and moves nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores)


def dealt_by(df: DataFrame, keys: Sequence[str], rows: int = 500_000) -> DataFrame:
    """``df`` dealt by its keys into tasks of about ``rows`` rows, more of them as the table grows.

    With a fixed number of shuffle partitions what a task sorts and joins by these keys grows with the table.  The rows of a
    stored table are counted from its footers.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def numbered(df: DataFrame) -> DataFrame:
    """``row, _doc``: the rows of ``df`` written once with a number each.

    A number made while a table is read depends on how the files are split, which changes with the executors at
    hand, so rows are joined by stored numbers only.
    """
    return checkpointed(df.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("_doc")))

"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ripplework")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ripplework-checkpoint-")
    sc.setCheckpointDir(folder)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ripplework-")) / "ripplework.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))  # Spark copies it to every executor
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: cut lineage, fixed values.

    Unlike ``checkpoint()`` this computes ``df`` once, keeps column pruning and gives the planner the
    true size of what follows.
    """
    return _written(df, {})


def checkpointed_wide(df: DataFrame, group_rows: int) -> DataFrame:
    """``checkpointed`` for rows of some MB, ``group_rows`` in a row group.

    Writers and readers hold a row group in memory, and without a limit it gets 100 rows before its size is looked at.
    """
    return _written(df, {"parquet.block.row.count.limit": group_rows, "parquet.page.size.row.check.min": 1})


def _written(df: DataFrame, options: dict[str, int]) -> DataFrame:
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over twice the shuffle partitions for work that is costly per row.

    Adaptive execution merges partitions by their bytes; a fixed number keeps few but expensive rows
    on many tasks. It must differ from the number used by joins on the same keys, because an equal
    partitioning is taken as already there and then merged after all.
    """
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)

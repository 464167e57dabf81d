"""Session settings and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows one task may hold in a window or in a sort of one group.
ROWS_PER_TASK = 1_000_000
# Distinct values one task may hold for an exact percentile of one group.
VALUES_PER_TASK = 2_000_000


def build_session(app: str = "corelode", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def limit_of(spark: SparkSession, name: str, default: int) -> int:
    """A limit from the session (``corelode.<name>``), or the default."""
    return int(spark.conf.get(f"corelode.{name}", str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session within one machine's process (master ``local`` or
    ``local[...]``) without that setting gets a temporary folder; on a cluster a
    machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="corelode-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _kept_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corelode/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A fresh path among this application's tables."""
    return f"{_kept_folder(spark)}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where two passes must see the very same rows (range boundaries,
    iterations): the lineage ends at the table, so a lost executor re-reads it
    instead of re-running the passes before it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete the tables this application has kept, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_kept_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

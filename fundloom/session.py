"""Session, table access and materialisation shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pandas as pd
from pyarrow import parquet
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest relation, in rows, that an operator may broadcast on its own decision.
BROADCAST_ROWS = 200_000


def get_spark(app: str = "fundloom", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each context, wherever it lies on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_fundloom_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="fundloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "fundloom_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._fundloom_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of our own only where it is unset and the session is local.

    On a cluster without the setting this raises, since executors can't read each other's folders.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="fundloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage like checkpoint(), but computes `df` once, keeps it columnar and lets later
    reads prune columns. Survives the loss of executors, since the files lie in the shared folder.
    The folder of the application is deleted when its driver ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/fundloom/{spark.sparkContext.applicationId}"
    path = f"{home}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def read_block(uri: str, columns: list[str] | None = None) -> pd.DataFrame:
    """The rows of one file of a materialised table, read in a task."""
    files, path = FileSystem.from_uri(uri)
    return parquet.read_table(path, columns=columns, filesystem=files).to_pandas()


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows stay within `limit`; else leave the join to AQE."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than those; else as it is, without a shuffle.

    For costly work on each row of a table that is read from a few files.
    """
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(workers(df.sparkSession)) if parts < df.sparkSession.sparkContext.defaultParallelism else df


def workers(spark: SparkSession) -> int:
    """Partitions to spread Python work over: the session's shuffle partitions, at least the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

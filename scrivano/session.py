"""Session helpers: table loading, shared checkpoints, broadcast guards."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast; beyond it callers shuffle.
BROADCAST_ROWS = 20_000


def local_session(app: str = "scrivano", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one is made only where none is set (single machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = checkpoint.get() if checkpoint.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="scrivano-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/scrivano-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there: lineage ends, a lost executor costs nothing, and
    the next plan sees true sizes (a checkpoint() would carry on the product of its joins' estimates).

    ``spent`` are earlier cuts that only this one still needed; their files are removed once this one is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove the files of cuts that no plan reads any more; frames that aren't cuts are left alone."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after the size was checked."""
    return F.broadcast(df) if fits(df, rows) else df

"""Tables as document stores: insert if absent, populate if empty, reset, banks of patterns and procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivano.functions import text as T
from scrivano.session import cut
from scrivano.session import drop as drop_cut


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of blank-free id and text whose id the store has not; the first of equal ids by ``pos``."""
    r = rows.where((T.strip(F.coalesce("id", F.lit(""))) != "") & (T.strip(F.coalesce("text", F.lit(""))) != ""))
    first = r.groupBy("id").agg(F.min(F.struct("pos", *[c for c in r.columns if c not in ("id", "pos")])).alias("f"))
    return first.select("id", "f.*").join(existing.select("id"), "id", "left_anti")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The store, empty where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def append(rows: DataFrame, path: str) -> int:
    """Insert if absent; returns the number of rows added.

    The new rows are written once beside the store and counted there.  One writer at a time: two that run at once may
    both add an id (the stream has one, and micro-batches follow each other).
    """
    out = cut(new_rows(rows, read(rows.sparkSession, path, rows.schema)).select(*rows.columns))
    n = out.count()
    if n:
        out.write.mode("append").parquet(path)
    drop_cut(out)
    return n


def populate(rows: DataFrame, path: str) -> bool:
    """Write only where the store is empty."""
    if read(rows.sparkSession, path, rows.schema).isEmpty():
        rows.write.mode("append").parquet(path)
        return True
    return False


def drop(spark: SparkSession, path: str) -> bool:
    """Remove the store; False if there was none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def pattern_rows(items: DataFrame) -> DataFrame:
    """``items(label, pattern, source_doc)`` to bank rows: the id is the content's hash, the first source wins."""
    h = F.concat("label", F.lit("_"), F.substring(F.sha1(F.concat_ws("::", "label", "pattern")), 1, 24))
    p = items.where("pattern is not null and pattern <> ''").withColumn("id", h)
    return p.groupBy("id").agg(F.min(F.struct("source_doc", "label", "pattern")).alias("f")).select("id", "f.label", "f.pattern", "f.source_doc")

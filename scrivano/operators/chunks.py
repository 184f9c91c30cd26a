"""Passages, blind character chunks and definition chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import text as T

MOST = 1200


def paragraphs(lns: DataFrame) -> DataFrame:
    """Maximal runs of non-blank lines: ``doc_id, line_start, line_end, text``."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    blank = T.strip(F.col("line")) == ""
    runs = lns.withColumn("blank", blank).withColumn("island", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    g = runs.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return g.select("doc_id", "line_start", "line_end", T.strip(F.array_join(F.transform("ls", lambda x: x.line), "\n")).alias("text")).where("text <> ''")


def pack(c, most: int = MOST):
    """Sentences packed greedily into pieces; a piece counts one joining blank per sentence, one that is too long alone
    stays whole."""
    parts = F.split(c, r"(?U)(?<=[.;:])\s+")
    start = F.expr("named_struct('done', cast(array() as array<string>), 'cur', cast(array() as array<string>), 'n', 0)")

    def step(a, p):
        flush = (a["n"] + F.length(p) + 1 > most) & (F.size(a["cur"]) > 0)
        return F.struct(
            F.when(flush, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]).alias("done"),
            F.when(flush, F.array(p)).otherwise(F.concat(a["cur"], F.array(p))).alias("cur"),
            F.when(flush, F.length(p) + 1).otherwise(a["n"] + F.length(p) + 1).alias("n"),
        )

    packed = F.aggregate(parts, start, step, lambda a: F.concat(a["done"], F.array(F.array_join(a["cur"], " "))))
    return F.filter(F.transform(F.when(F.length(c) > most, packed).otherwise(F.array(c)), T.strip), lambda x: x != "")


def passages(lns: DataFrame, most: int = MOST) -> DataFrame:
    """``id, doc_id, chunk_id, line_start, line_end, text``: paragraphs, long ones packed; pieces keep the paragraph's
    lines; ``chunk_id`` runs per document from 0."""
    p = paragraphs(lns).select("doc_id", "line_start", "line_end", F.posexplode(pack(F.col("text"), most)).alias("piece", "text"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_start", "piece")) - 1
    p = p.withColumn("chunk_id", n)
    return p.select(T.stable_id("passage", "doc_id", "line_start", "line_end", "chunk_id").alias("id"), "doc_id", "chunk_id", "line_start", "line_end", "text")


BOUNDARY = r"([\.!?])(\s|\n)|(\n{2,})|(;)(\s|\n)"


def blind_chunks(docs: DataFrame, least: int = 2000, most: int = 3000) -> DataFrame:
    """Chunks ``[start_char, end_char)`` that tile the text: each ends after the first boundary between ``least`` and
    ``most`` characters, else at ``most``; what is left below ``least`` is the last chunk."""
    n = F.length("text")
    start = F.expr("named_struct('i', 0, 'o', cast(array() as array<struct<s:int,e:int>>))")

    def step(a, _):
        i = a["i"]
        win = F.substr(F.col("text"), i + least + 1, F.lit(most - least))
        hit = F.regexp_extract(win, "(?U)(" + BOUNDARY + ")", 1)
        at = F.regexp_instr(win, F.lit("(?U)" + BOUNDARY))
        end = F.when(i + least >= n, n).when(hit != "", i + least + at - 1 + F.length(hit)).otherwise(F.least(n, i + most))
        new = F.struct(end.cast("int").alias("i"), F.concat(a["o"], F.array(F.struct(i.cast("int").alias("s"), end.cast("int").alias("e")))).alias("o"))
        return F.when(i >= n, a).otherwise(new)

    rounds = F.sequence(F.lit(0), F.floor(n / least).cast("int"))
    o = F.aggregate(rounds, start, step, lambda a: a["o"])
    return docs.select("doc_id", "text", F.posexplode(o).alias("chunk_id", "c")).select(
        "doc_id", "chunk_id", F.col("c.s").alias("start_char"), F.col("c.e").alias("end_char"), F.substr("text", F.col("c.s") + 1, F.col("c.e") - F.col("c.s")).alias("text")
    )


def definition_chunks(defs: DataFrame, most: int = 900) -> DataFrame:
    """``term: definition`` chunks with ids by position; blank ones skipped."""
    t = F.substring(F.concat(T.strip(F.coalesce("term", F.lit(""))), F.lit(": "), T.strip(F.coalesce("definition", F.lit("")))), 1, most)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "term", "definition")) - 1
    kept = defs.where(T.strip(F.coalesce("definition", F.lit(""))) != "").withColumn("pos", pos)
    return kept.select(T.stable_id("def", "doc_id", "pos", "term").alias("id"), "doc_id", "section_id", "term", "line_no", t.alias("text"))

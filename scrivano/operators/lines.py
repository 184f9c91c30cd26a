"""Documents to lines, repeated headers, title candidates, line windows, line chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import scores as S
from scrivano.functions import text as T

HEADER_MIN, MIN_SCORE, MOST_CANDIDATES, MOST_ITEMS = 3, 0.22, 900, 220


def documents(df: DataFrame, rstrip: bool = True) -> DataFrame:
    """``doc_id`` as text and normalised ``text``; blank and null documents are dropped."""
    return df.where(F.col("text").rlike(r"(?U)\S")).select(F.col("doc_id").cast("string").alias("doc_id"), T.normalize_text(F.col("text"), rstrip).alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: one row per line, numbered from 0."""
    return docs.select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line"))


def line_stats(lns: DataFrame) -> DataFrame:
    s = T.strip(F.col("line"))
    return lns.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(s == "").alias("n_blank"), F.max(F.length("line")).alias("longest"))


def line_chunks(lns: DataFrame) -> DataFrame:
    """One chunk per non-blank line, with a stable id."""
    return lns.select(T.stable_id("line", "doc_id", "line_no").alias("id"), "doc_id", "line_no", T.strip(F.col("line")).alias("text")).where("text <> ''")


def repeated_headers(lns: DataFrame, least: int = HEADER_MIN) -> DataFrame:
    """Line keys of eight characters or more, not of digits only, that a document repeats."""
    k = lns.select("doc_id", T.header_key(F.col("line")).alias("key")).where((F.length("key") >= 8) & ~F.col("key").rlike(r"(?U)^[0-9\s]+$"))
    return k.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def title_candidates(lns: DataFrame, min_score: float = MIN_SCORE, most: int = MOST_CANDIDATES, header_min: int = HEADER_MIN) -> DataFrame:
    """``doc_id, line_no, candidate, score``: lines that score as titles, without repeated headers, and bare
    attachments only before a heading; at most ``most`` per document in line order."""
    by_doc = Window.partitionBy("doc_id")
    cur = lns.withColumn("next", F.lead("line", 1, "").over(by_doc.orderBy("line_no"))).withColumn("candidate", T.strip(F.col("line")))
    cur = cur.withColumn("score", S.title_score(F.col("candidate"))).where(F.col("score") >= min_score)
    cur = cur.where(~S.bare_attachment(F.col("candidate")) | S.looks_like_heading(F.col("next"))).withColumn("key", T.header_key(F.col("candidate")))
    kept = cur.join(repeated_headers(lns, header_min).select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    rank = F.row_number().over(by_doc.orderBy("line_no"))
    return kept.withColumn("rn", rank).where(F.col("rn") <= most).select("doc_id", "line_no", "candidate", "score")


def title_topk(cands: DataFrame, k: int = MOST_ITEMS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "line_no"))
    return cands.withColumn("rank", rank).where(F.col("rank") <= k)


def context(lns: DataFrame, radius: int = 2) -> DataFrame:
    """Every line with its neighbours up to ``radius``, clipped at the document's ends."""
    frame = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-radius, radius)
    return lns.withColumn("context_lines", F.collect_list(F.struct("line_no", F.col("line").alias("text"))).over(frame))


def title_items(lns: DataFrame, k: int = MOST_ITEMS) -> DataFrame:
    """Candidates as a model sees them: context lines and the feature struct."""
    top = title_topk(title_candidates(lns), k)
    near = context(lns).select("doc_id", "line_no", "context_lines")
    c = F.col("candidate")
    features = F.struct(
        F.bround(T.upper_ratio(c), 3).alias("upper_ratio"), T.starts_upper(c).alias("starts_with_upper"), c.endswith(":").alias("ends_with_colon"),
        S.numbered(c).alias("has_number_prefix"), S.bare_attachment(c).alias("is_bare_allegato"), T.word_count(c).alias("word_count"),
    )
    return top.join(near, ["doc_id", "line_no"]).select("doc_id", "line_no", "candidate", "score", "rank", "context_lines", features.alias("features"))

"""Memory across documents: banks of patterns and of procedures, what is read from them and what goes back.

A bank is a table; reading sees it as of the start of the batch.  Queries without any bank row find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import context, retrieval, store

PATTERNS = "id string, label string, pattern string, source_doc string"
PROCEDURES = "id string, source_doc string, section_title string, section_path string, status string, n_steps int, text string"
PROCEDURAL, NONPROCEDURAL, TITLE = "procedural_section_pattern", "nonprocedural_section_pattern", "title_pattern"


def _nearest(queries: DataFrame, bank: DataFrame, text: str, k: int) -> DataFrame:
    """``query_id, rank, id`` of the bank rows nearest to ``queries(query_id, query)``."""
    q = queries.select("query_id", retrieval.hashing_embedder(F.col("query")).alias("qvec"))
    return retrieval.knn(q, bank.select("id", retrieval.hashing_embedder(F.col(text)).alias("vec")), k).drop("distance")


def packed(label: Column, pattern: Column, source: Column) -> Column:
    """An example as prompts show it; hits have distances and no score, so the score is null."""
    none = F.lit(None).cast("string")
    return F.struct(label.alias("label"), F.lit("").alias("hint"), pattern.alias("pattern"), source.alias("source_id"), none.alias("score"))


def title_examples(cands: DataFrame, bank: DataFrame, k: int = 8) -> DataFrame:
    """``doc_id, examples``: title patterns nearest to the document's first 15 candidates."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = cands.withColumn("n", F.row_number().over(w)).where("n <= 15").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "candidate"))).alias("cs"))
    q = first.select(F.col("doc_id").alias("query_id"), F.substring(F.array_join(F.transform("cs", lambda x: x.candidate), " \n"), 1, 700).alias("query"))
    mine = bank.where(F.col("label") == TITLE)
    hits = _nearest(q, mine, "pattern", k).join(mine, "id")
    return hits.groupBy(F.col("query_id").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", packed(F.col("label"), F.col("pattern"), F.col("id")).alias("e")))), lambda x: x.e).alias("examples"))


def section_examples(sections: DataFrame, bank: DataFrame, k: int = 4) -> DataFrame:
    """``section_id, examples`` for ``sections(section_id, title, text)``: the ``k`` nearest procedural patterns, then the
    ``k`` nearest others."""
    q = sections.select(F.col("section_id").alias("query_id"), F.substring(F.concat("title", F.lit("\n"), F.substring("text", 1, 450)), 1, 700).alias("query"))
    hits = None
    for no, label in enumerate((PROCEDURAL, NONPROCEDURAL)):
        mine = bank.where(F.col("label") == label)
        one = _nearest(q, mine, "pattern", k).join(mine, "id").withColumn("no", F.lit(no))
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy(F.col("query_id").alias("section_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "rank", packed(F.col("label"), F.col("pattern"), F.col("id")).alias("e")))), lambda x: x.e).alias("examples"))


def local_similar(sections: DataFrame, passages: DataFrame, k: int = 4) -> DataFrame:
    """``section_id, similar``: texts of the document's passages nearest to the section's first 700 characters."""
    q = sections.select(F.col("section_id").alias("query_id"), "doc_id", retrieval.hashing_embedder(F.substring("text", 1, 700)).alias("qvec"))
    hits = retrieval.knn(q, passages.select("doc_id", "id", retrieval.hashing_embedder(F.col("text")).alias("vec")), k, on=["doc_id"])
    hits = hits.join(passages.select("id", "text"), "id")
    return hits.groupBy(F.col("query_id").alias("section_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x.text).alias("similar"))


def similar_procedures(sections: DataFrame, bank: DataFrame, k: int = 6, keep: int = 3) -> DataFrame:
    """``section_id, similar``: of the ``k`` nearest procedures of the bank the first ``keep`` of other documents."""
    text = F.concat_ws("\n", "title", "path", F.substring("text", 1, 1200))
    q = sections.select(F.col("section_id").alias("query_id"), F.substring(text, 1, 1800).alias("query"))
    hits = _nearest(q, bank, "text", k).join(bank.select("id", "source_doc"), "id")
    hits = retrieval.without_own(hits, sections.select(F.col("section_id").alias("query_id"), F.col("doc_id").alias("doc")), keep).drop("source_doc").join(bank, "id")
    flat = F.struct("id", "source_doc", "section_title", "section_path", "status", "text", F.lit(None).cast("string").alias("score"))
    return hits.groupBy(F.col("query_id").alias("section_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", flat.alias("p")))), lambda x: x.p).alias("similar"))


def pattern_rows(titles: DataFrame, flags: DataFrame) -> DataFrame:
    """What a batch gives to the bank of patterns: its titles and every classified section, distinct by content."""
    t = titles.select(F.lit(TITLE).alias("label"), T.title_pattern(F.col("title")).alias("pattern"), F.col("doc_id").alias("source_doc"))
    s = flags.select(F.when(F.col("is_procedure"), PROCEDURAL).otherwise(NONPROCEDURAL).alias("label"), T.section_pattern(F.col("title"), F.col("text"), F.col("is_procedure")).alias("pattern"), F.col("doc_id").alias("source_doc"))
    return store.pattern_rows(t.unionByName(s))


def procedure_rows(records: DataFrame) -> DataFrame:
    """What a batch gives to the bank of procedures: the summary text of each, by a stable id."""
    text = context.procedure_summary(*map(F.col, ("doc_id", "section_title", "section_path", "steps", "notes")))
    return records.select(
        T.stable_id("global_proc", "doc_id", "sec_idx", "section_title", "section_path").alias("id"), F.col("doc_id").alias("source_doc"), "section_title", "section_path", "status", F.size("steps").alias("n_steps"), text.alias("text")
    ).dropDuplicates(["id"])


def add_patterns(rows: DataFrame, path: str) -> int:
    return store.append(rows.withColumn("text", F.col("pattern")).withColumn("pos", F.lit(0)), path)


def add_procedures(rows: DataFrame, path: str) -> int:
    return store.append(rows.withColumn("pos", F.lit(0)), path)

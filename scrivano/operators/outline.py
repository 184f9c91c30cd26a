"""Title trees, sections, and the joins of lines and spans to sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import text as T

STACK = "cast(array() as array<struct<idx:int,level:int,title:string>>)"


def outline(titles: DataFrame, chars: bool = False) -> DataFrame:
    """Tree over ``titles(doc_id, start_line, level, title)``, ties in start order broken by title.

    ``doc_id, idx, title, level, start_line, end_line, parent_index, path``.  The parent is the last earlier title of
    a smaller level; the end is the start of the next title of the same level or a smaller one, minus one (for
    character offsets not minus one), null if there is none.
    """
    w = Window.partitionBy("doc_id").orderBy("start_line", "title", "level")
    t = titles.withColumn("idx", F.row_number().over(w) - 1).withColumn("level", F.col("level").cast("int"))
    before = F.collect_list(F.struct("idx", "level", "title")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("stack", F.aggregate(before, F.expr(STACK), lambda acc, c: F.concat(F.filter(acc, lambda x: x.level < c.level), F.array(c))))
    after = F.collect_list(F.struct("level", "start_line")).over(w.rowsBetween(1, Window.unboundedFollowing))
    nxt = F.get(F.filter(after, lambda x: x.level <= F.col("level")), F.lit(0))
    end = nxt["start_line"] - (0 if chars else 1)
    return t.select(
        "doc_id", "idx", "title", "level", "start_line", end.alias("end_line"), F.try_element_at("stack", F.lit(-2))["idx"].alias("parent_index"),
        F.array_join(F.transform("stack", lambda x: x.title), " > ").alias("path"),
    )


def sections(tree: DataFrame, docs_lines: DataFrame) -> DataFrame:
    """Inclusive line bounds of every title and of documents without titles ("DOCUMENTO"); empty ones are kept.

    ``docs_lines(doc_id, n_lines)`` gives the documents' lengths.
    """
    s = docs_lines.join(tree, "doc_id", "left").select(
        "doc_id", F.coalesce("idx", F.lit(0)).alias("sec_idx"), F.coalesce("start_line", F.lit(0)).alias("start_line"),
        F.coalesce("end_line", (F.col("n_lines") - 1).cast("int")).alias("end_line"), F.coalesce("title", F.lit("DOCUMENTO")).alias("title"), F.coalesce("path", F.lit("DOCUMENTO")).alias("path"),
    )
    return s.withColumn("section_id", T.stable_id("sec", "doc_id", "start_line", "end_line", F.substring("title", 1, 80)))


def section_texts(secs: DataFrame, lns: DataFrame) -> DataFrame:
    """Sections with their text, blank ones left out.  Each document's lines are gathered once, not once per section."""
    doc = lns.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line).alias("ls"))
    part = F.array_join(F.slice("ls", F.col("start_line") + 1, F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    return secs.join(doc, "doc_id").withColumn("text", T.strip(part)).drop("ls").where("text <> ''")


def parent_chunks(texts: DataFrame, most: int = 1200) -> DataFrame:
    """Section chunks for parent and child retrieval: title, path and the head of the text."""
    body = F.concat_ws("\n", "title", "path", F.lit(""), F.substring("text", 1, most))
    return texts.select(T.stable_id("sec_doc", "doc_id", "section_id").alias("id"), "doc_id", "section_id", "title", "path", body.alias("text"))


def line_sections(lns: DataFrame, secs: DataFrame) -> DataFrame:
    """The first section in start order that holds the line; null before the first title."""
    s = secs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec_idx", "start_line", "end_line", "section_id"))).alias("ss"))
    hit = F.get(F.filter("ss", lambda x: (x.start_line <= F.col("line_no")) & (F.col("line_no") <= x.end_line)), F.lit(0))
    return lns.join(s, "doc_id", "left").select("doc_id", "line_no", hit["section_id"].alias("section_id"))


def span_sections(spans: DataFrame, secs: DataFrame) -> DataFrame:
    """The section of largest overlap with ``spans(doc_id, span_id, a, b)``, the first on ties, null without overlap.

    A span given backwards is turned round.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    s = secs.groupBy("doc_id").agg(F.collect_list(F.struct("sec_idx", "start_line", "end_line", "section_id")).alias("ss"))
    over = F.transform("ss", lambda x: F.struct((F.least(x.end_line, hi) - F.greatest(x.start_line, lo) + 1).alias("n"), (-x.sec_idx).alias("i"), x.section_id.alias("section_id")))
    best = F.array_max(F.filter(over, lambda x: x.n > 0))
    return spans.join(s, "doc_id", "left").select("doc_id", "span_id", "a", "b", best["section_id"].alias("section_id"), best["n"].alias("overlap"))

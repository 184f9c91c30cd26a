"""Context for model stages: summaries of procedures, definition blocks of agents, and the assembly under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import retrieval

MOST_BLOCKS, MOST_AGENT_BLOCKS, BLOCK_CHARS, MOST_AGENTS = 12, 8, 900, 6


def procedure_summary(doc: Column, title: Column, path: Column, steps: Column, notes: Column) -> Column:
    """A procedure as one text block: at most 20 steps and 10 notes, '-' where there is nothing."""
    def listed(items: Column, n: int) -> Column:
        kept = F.slice(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, n)
        return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("-")

    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return F.concat_ws("\n", F.concat(F.lit("DOC_ID: "), dash(doc)), F.concat(F.lit("SECTION_TITLE: "), dash(title)), F.concat(F.lit("PATH: "), dash(path)), F.lit("STEPS:"), listed(steps, 20), F.lit("NOTES:"), listed(notes, 10))


def mentioned(agents: DataFrame, sections: DataFrame, most: int = MOST_AGENTS) -> DataFrame:
    """Agents of a document that a section's text names, the first ``most`` in their order: ``doc_id, section_id, pos,
    agent``.  ``agents(doc_id, pos, agent)`` is gathered per document; it is bounded by the allowed agents."""
    a = agents.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "agent"))).alias("as"))
    low = F.lower("text")
    hit = F.slice(F.filter("as", lambda x: (T.strip(x.agent) != "") & low.contains(F.lower(T.strip(x.agent)))), 1, most)
    return sections.join(a, "doc_id").select("doc_id", "section_id", F.posexplode(hit).alias("pos", "x")).select("doc_id", "section_id", "pos", F.col("x.agent").alias("agent"))


def definition_support(sections: DataFrame, agents: DataFrame, definitions: DataFrame, queries: int = 4, k: int = 4, per: int = 2, parents: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Definition blocks for the agents a section names: ``doc_id, section_id, agent, place, id, text``.

    Each agent asks up to ``queries`` sub-queries of its document's ``definitions(doc_id, id, term, text)``, k hits
    each; equal (term, section, text head) count once and the first ``per`` stay.  With ``parents(doc_id, id, vec)``,
    sections by id with their text, an agent's first query chooses the ``top`` nearest and only definitions of these
    sections (column ``section_id``) are asked, section by section; a document without sections is asked as a whole.
    """
    m = mentioned(agents, sections)
    q = m.select("doc_id", "section_id", "agent", F.posexplode(T.agent_queries(F.col("agent"), queries)).alias("q", "query"))
    q = q.withColumn("qvec", F.col("query"))
    d = definitions.withColumn("vec", F.coalesce("text", F.lit("")))
    home = F.col("section_id") if "section_id" in definitions.columns else F.lit(None).cast("string")
    d = d.select("doc_id", "id", "term", "text", "vec", home.alias("home"))
    who = ("doc_id", "section_id", "agent")

    def ask(qs: DataFrame, on: list[str]) -> DataFrame:
        ids = qs.withColumn("query_id", F.struct(*who, "p", "q"))
        return retrieval.knn(ids.select("query_id", "qvec", *on), d, k, on=on).select("query_id.*", "rank", "id")

    if parents is None:
        hits = ask(q.withColumn("p", F.lit(0)), ["doc_id"])
    else:
        first = q.where("q = 0").select(F.struct(*who).alias("query_id"), "qvec", "doc_id")
        best = retrieval.knn(first, parents, top, on=["doc_id"]).select("query_id.*", F.col("rank").alias("p"), F.col("id").alias("home"))
        flat = q.join(best.select(*who).distinct(), list(who), "left_anti").withColumn("p", F.lit(0))
        hits = ask(q.join(best, list(who)), ["doc_id", "home"]).unionByName(ask(flat, ["doc_id"]))
    h = hits.join(d.select("doc_id", "id", "term", "text", "home"), ["doc_id", "id"])
    key = Window.partitionBy(*who, "term", "home", F.substring("text", 1, 60)).orderBy("p", "q", "rank")
    h = h.withColumn("f", F.row_number().over(key)).where("f = 1")
    n = F.row_number().over(Window.partitionBy(*who).orderBy("p", "q", "rank", "id"))
    return h.withColumn("place", n).where(F.col("place") <= per).select(*who, "place", "id", "text")


def section_context(sections: DataFrame, agents: DataFrame, definitions: DataFrame, passages: DataFrame, parents: DataFrame, n_lines: DataFrame) -> DataFrame:
    """Context of every section by retrieval in its own document: ``section_id, place, kind, id, text``.

    ``sections(doc_id, section_id, title, text, start_line, end_line)`` ask with their support query: passages come from
    the three nearest sections, those that touch the section itself left out; definitions of the agents it names, or
    where it names none the definitions of the nearest sections, one per term.  ``definitions(doc_id, id, term, text,
    section_id)``, ``passages(doc_id, id, chunk_id, line_start, line_end, text, section_id)``, ``parents(doc_id,
    section_id, text)``, ``n_lines(doc_id, n_lines)``; longer documents ask for less.  Ids are evidence ids.
    """
    lines = F.col("n_lines")
    q = sections.join(n_lines, "doc_id").withColumn("qvec", T.support_query(F.coalesce("title", F.lit(""))))
    par = parents.select("doc_id", F.col("section_id").alias("id"), F.coalesce("text", F.lit("")).alias("vec"))
    ps = passages.select("doc_id", "id", F.col("section_id").alias("parent"), F.coalesce("text", F.lit("")).alias("vec"))
    ask = lambda base, low: q.select(F.col("section_id").alias("query_id"), "doc_id", "qvec", T.adaptive_k(lines, base, low, base).alias("k"))
    hits = retrieval.parent_child(ask(6, 3), par, ps, per=6, on=["doc_id"]).select(F.col("query_id").alias("section_id"), "place", "id")
    own = sections.select("section_id", "doc_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    p = hits.join(passages.select("id", "chunk_id", "line_start", "line_end", "text"), "id").join(own, "section_id")
    p = p.where(retrieval.outside(F.col("line_start"), F.col("line_end"), F.col("a"), F.col("b")))
    p = p.select("section_id", F.col("place").alias("pos"), F.concat(F.lit("doc_"), "doc_id", F.lit("_passage_"), "chunk_id").alias("id"), "text")
    named = F.concat("doc_id", F.lit("_def_"), F.coalesce("term", F.lit("")), F.lit("_"), F.coalesce("home", F.lit("")))
    order = F.row_number().over(Window.partitionBy("section_id").orderBy("agent_pos", "place"))
    support = definition_support(sections, agents, definitions, parents=par)
    support = support.join(agents.groupBy("doc_id", "agent").agg(F.min("pos").alias("agent_pos")), ["doc_id", "agent"]).join(definitions.select("doc_id", "id", "term", F.col("section_id").alias("home")), ["doc_id", "id"])
    blocks = support.select("section_id", order.alias("pos"), named.alias("id"), "text")
    ds = definitions.select("doc_id", "id", F.col("section_id").alias("parent"), F.coalesce("text", F.lit("")).alias("vec"))
    dh = retrieval.parent_child(ask(4, 2), par, ds, per=4, on=["doc_id"]).select(F.col("query_id").alias("section_id"), F.col("place").alias("pos"), "id")
    dh = dh.join(definitions.select("id", "doc_id", "term", "text"), "id").select("section_id", "pos", F.concat(F.lit("doc_"), "doc_id", F.lit("_definition_"), "term").alias("id"), F.lower(T.strip(F.col("term"))).alias("term"), "text")
    return assemble(blocks, dh, p)


def assemble(agent_blocks: DataFrame, definition_hits: DataFrame, passages: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Context of a section, at most ``most`` blocks: up to eight agent blocks, or definition hits where there are
    none (one per term), then passages: ``section_id, place, kind, id, text``.

    Inputs have ``section_id, pos, id, text``; definition hits also ``term``.
    """
    w = Window.partitionBy("section_id").orderBy("pos", "id")
    a = agent_blocks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_AGENT_BLOCKS)
    a = a.select("section_id", F.lit(0).alias("prio"), "n", F.lit("definition").alias("kind"), "id", "text")
    one = definition_hits.groupBy("section_id", "term").agg(F.min(F.struct("pos", "id", "text")).alias("f")).select("section_id", "f.*")
    d = one.join(a.select("section_id").distinct(), "section_id", "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_AGENT_BLOCKS)
    d = d.select("section_id", F.lit(1).alias("prio"), "n", F.lit("definition").alias("kind"), "id", "text")
    p = passages.select("section_id", F.lit(2).alias("prio"), F.col("pos").alias("n"), F.lit("passage").alias("kind"), "id", "text")
    u = a.unionByName(d).unionByName(p)
    place = F.row_number().over(Window.partitionBy("section_id").orderBy("prio", "n", "id"))
    return u.withColumn("place", place).where(F.col("place") <= most).select("section_id", "place", "kind", "id", F.substring("text", 1, BLOCK_CHARS).alias("text"))


def label_lines(wrapped: Column) -> Column:
    """Lines of a label wrapped with a literal \\n."""
    return F.when(F.coalesce(wrapped, F.lit("")) == "", 1).otherwise(F.size(F.split(wrapped, r"\\n")))


def diameter(lines: Column, base: float = 1.0, add: float = 0.22, low: float = 1.0, high: float = 2.8) -> Column:
    d = F.greatest(F.lit(low), F.least(F.lit(high), base + F.greatest(lines - 1, F.lit(0)) * add))
    return F.format_string("%.2f", d)


def lane_header_px(name: Column) -> Column:
    return F.greatest(F.lit(90.0), F.least(F.lit(220.0), 28 + 7.2 * F.length(name))).cast("int")


def unique_labels(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Repeated names of a group become "name (2)", "name (3)" in order."""
    k = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return rows.withColumn("k", k).withColumn("label", F.when(F.col("k") > 1, F.concat(name, F.lit(" ("), F.col("k"), F.lit(")"))).otherwise(F.col(name))).drop("k")

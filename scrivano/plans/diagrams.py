"""Diagram runs: three layouts of every procedure as source text, with the outcome of each, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import graph
from scrivano.session import cut
from scrivano.sources import files

LAYOUTS = {"strategy": "dot", "agent_lanes": "dot", "bpmn": "piperflow.txt"}


def collected_steps(procedures: DataFrame) -> DataFrame:
    """``procedure_id, step_idx, id, type, agent, description_synthetic, meta, branches`` of ``procedures(procedure_id,
    steps, points)``: the steps, or those of the points where there are none; steps without an id are left out."""
    steps = F.col("steps")
    if "points" in procedures.columns:
        steps = F.when(F.size("steps") > 0, steps).otherwise(F.flatten(F.transform("points", lambda p: p.steps)))
    s = procedures.select("procedure_id", F.posexplode(F.filter(steps, lambda x: x.isNotNull() & (F.coalesce(x.id, F.lit("")) != ""))).alias("step_idx", "s"))
    return s.select("procedure_id", "step_idx", "s.*")


def links_of(steps: DataFrame) -> DataFrame:
    """Branches of collected steps as ``graph.link_steps`` gives them."""
    return steps.select("procedure_id", "step_idx", "id", "type", F.posexplode("branches").alias("branch_no", "b")).select("procedure_id", "step_idx", "id", "type", "branch_no", F.coalesce("b.label", F.lit("")).alias("label"), F.col("b.target").alias("target"))


def literal(c) -> Column:
    """Text that may stand inside a quoted Python literal: backslashes and quotes escaped."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("'"), F.lit("\\'"))


def three_layouts(procedures: DataFrame) -> DataFrame:
    """``doc_id, procedure_id, layout, source, status`` for ``procedures(procedure_id, doc_id, subsection_title, steps,
    points)``: flat and by agents for Graphviz, and lanes; a procedure without steps has no source and status 'FAIL'."""
    found = cut(collected_steps(procedures))
    steps, links = found.drop("branches"), links_of(found)
    titles = procedures.select("procedure_id", F.coalesce("subsection_title", F.lit("")).alias("title")).dropDuplicates(["procedure_id"])
    alias = graph.alias_of(F.col("type"), F.col("id")).alias("node")
    nodes = steps.select("procedure_id", alias).unionByName(steps.select("procedure_id", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("node")))
    e = cut(graph.filter_edges(graph.edges(steps, links), nodes))
    made = (
        graph.dot_source(steps, e, titles).select("procedure_id", F.lit("strategy").alias("layout"), F.col("dot").alias("source"))
        .unionByName(graph.dot_source(steps, e, titles, lanes=True).select("procedure_id", F.lit("agent_lanes").alias("layout"), F.col("dot").alias("source")))
        .unionByName(graph.lane_diagram(steps, graph.limited_edges(e), titles).select("procedure_id", F.lit("bpmn").alias("layout"), F.col("dsl").alias("source")))
    )
    want = procedures.select("doc_id", "procedure_id").distinct().withColumn("layout", F.explode(F.array(*map(F.lit, LAYOUTS))))
    out = want.join(made, ["procedure_id", "layout"], "left")
    return out.select("doc_id", "procedure_id", "layout", "source", F.when(F.col("source").isNotNull(), "OK").otherwise("FAIL").alias("status"))


def counts(layouts: DataFrame) -> DataFrame:
    """Procedures drawn and failed by document and layout."""
    return layouts.groupBy("doc_id", "layout").agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "FAIL").alias("fail"))


def layout_files(layouts: DataFrame) -> DataFrame:
    """``path, content``: a folder a document and layout, file names made safe."""
    end = F.lit(".piperflow.txt")
    for k, v in LAYOUTS.items():
        end = F.when(F.col("layout") == k, f".{v}").otherwise(end)
    return layouts.where("source is not null").select(F.concat_ws("/", "doc_id", "layout", F.concat(T.file_name(F.col("procedure_id")), end)).alias("path"), F.col("source").alias("content"))


def run(procedures: DataFrame, root: str) -> DataFrame:
    """Writes the sources of all procedures below ``root``; returns ``path, size, error``."""
    return files.write_files(layout_files(three_layouts(procedures)), root, indent=False)

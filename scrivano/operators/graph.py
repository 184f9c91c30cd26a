"""Procedure steps to process graphs: linking, edges, degree limits, diagram sources."""

from __future__ import annotations

import hashlib
import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import lexicon as L
from scrivano.functions import text as T

MOST_LINKS = 4
STEP = "array<struct<id:string,type:string,agent:string,description_synthetic:string,description:string,meta:string>>"


def coerce_steps(raw: DataFrame, column: str = "steps_json") -> DataFrame:
    """Model output to steps: ``procedure_id, step_idx, id, type, agent, description_synthetic, meta`` with defaults.

    Anything but a JSON array of objects gives no steps.
    """
    s = raw.select("procedure_id", F.posexplode(F.from_json(column, STEP)).alias("step_idx", "s")).where("s is not null")
    dflt = lambda c, v: T.strip(F.coalesce(F.nullif(c, F.lit("")), v))
    return s.select(
        "procedure_id", "step_idx", dflt(F.col("s.id"), (F.col("step_idx") + 1).cast("string")).alias("id"), dflt(F.col("s.type"), F.lit("activity_task")).alias("type"),
        dflt(F.col("s.agent"), F.lit(L.DEFAULT_AGENT)).alias("agent"), T.strip(F.coalesce(F.nullif(F.col("s.description_synthetic"), F.lit("")), F.col("s.description"), F.lit(""))).alias("description_synthetic"), T.strip(F.coalesce("s.meta", F.lit(""))).alias("meta"),
    )


def link_steps(steps: DataFrame) -> DataFrame:
    """Branches of every step: ``procedure_id, step_idx, id, type, branch_no, label, target``.

    A gateway collects the run of following steps whose meta starts with "branch="; labels are yes or no normalised and
    numbered when they repeat; an empty label gives no branch.  Other steps, and gateways without branches, go on to
    the next step or "end".
    """
    w = Window.partitionBy("procedure_id").orderBy("step_idx")
    s = steps.where("id is not null and id <> ''").withColumn("step_idx", F.row_number().over(w) - 1)
    s = s.withColumn("next", F.lead("id", 1, "end").over(w)).withColumn("is_branch", F.coalesce(F.col("meta").startswith("branch="), F.lit(False)))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    s = s.withColumn("stop", F.min(F.when(~F.col("is_branch"), F.col("step_idx"))).over(after))
    gates = s.where(F.col("type").startswith("gateway_")).select("procedure_id", F.col("step_idx").alias("g"), F.coalesce("stop", F.lit(1 << 30)).alias("stop"))
    arms = s.where("is_branch").select("procedure_id", F.col("step_idx").alias("j"), F.col("id").alias("target"), T.strip(F.substring("meta", 8, 1_000_000)).alias("raw"))
    got = gates.join(arms, "procedure_id").where("g < j and j < stop and raw <> ''").select("procedure_id", F.col("g").alias("step_idx"), "j", "target", T.yes_no(F.col("raw")).alias("name"))
    k = F.row_number().over(Window.partitionBy("procedure_id", "step_idx", "name").orderBy("j"))
    got = got.withColumn("k", k).select("procedure_id", "step_idx", "j", "target", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(F.col("name"), F.lit(" ("), F.col("k"), F.lit(")"))).alias("label"))
    full = s.select("procedure_id", "step_idx", "id", "type", "next").join(got, ["procedure_id", "step_idx"], "left")
    n = F.row_number().over(Window.partitionBy("procedure_id", "step_idx").orderBy("j")) - 1
    return full.withColumn("branch_no", n).select("procedure_id", "step_idx", "id", "type", "branch_no", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("target", "next").alias("target"))


def alias_of(kind, step_id):
    return F.when(kind == "event_start", "start").when(kind == "event_end", "end").otherwise(F.concat(F.lit("s_"), step_id))


def edges(steps: DataFrame, links: DataFrame) -> DataFrame:
    """``procedure_id, src, tgt, label``: branch edges to known steps, and a start edge to the first step where no
    start event exists; self-loops are dropped, equal edges count once."""
    a = steps.select("procedure_id", "step_idx", "id", alias_of(F.col("type"), F.col("id")).alias("alias"), (F.col("type") == "event_start").alias("is_start"))
    src = a.select("procedure_id", F.col("id").alias("id"), F.col("alias").alias("src")).dropDuplicates(["procedure_id", "id"])
    tgt = src.select("procedure_id", F.col("id").alias("target"), F.col("src").alias("known"))
    e = links.join(src, ["procedure_id", "id"]).join(tgt, ["procedure_id", "target"], "left")
    e = e.select("procedure_id", "src", F.coalesce("known", F.when(F.col("target") == "end", "end")).alias("tgt"), "label").where("tgt is not null")
    first = a.groupBy("procedure_id").agg(F.min_by("alias", "step_idx").alias("tgt"), F.max("is_start").alias("has")).where("not has")
    start = first.select("procedure_id", F.lit("start").alias("src"), "tgt", F.lit("").alias("label"))
    return e.unionByName(start).where("src <> tgt").distinct()


def filter_edges(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between declared ``nodes(procedure_id, node)``, no self-loops."""
    n = nodes.select("procedure_id", "node").distinct()
    ok = e.where("src <> '' and tgt <> '' and src <> tgt")
    ok = ok.join(n.withColumnRenamed("node", "src"), ["procedure_id", "src"], "left_semi")
    return ok.join(n.withColumnRenamed("node", "tgt"), ["procedure_id", "tgt"], "left_semi")


def degrees(e: DataFrame) -> DataFrame:
    both = e.select("procedure_id", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select("procedure_id", F.col("tgt").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("procedure_id", "node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _anchor(a: str, b: str) -> str:
    return "anc_" + hashlib.sha1(f"{a}>{b}".encode()).hexdigest()[:12]


def limit_degrees(arcs: list[tuple[str, str, str]], most: int = MOST_LINKS, rounds: int | None = None) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """Arcs rewritten so that no node has more than ``most`` links: crowded nodes get trees of merge or split gateways.

    A tree node takes at least two arcs, so trees always shrink; a node whose other side leaves less than that room is
    relieved on both sides in turn.  One node is relieved a round, until none is over the limit or after ``rounds``.
    The order of the arcs given does not count.  Returns the arcs and the added ``(alias, label)``.
    """
    arcs, added = sorted(arcs), []

    def link(a: str, b: str, label: str) -> None:
        if a.startswith("gw_") and b.startswith("gw_"):  # an empty task between two gateways
            mid = _anchor(a, b)
            added.append((mid, " "))
            arcs.extend([(a, mid, ""), (mid, b, label)])
        else:
            arcs.append((a, b, label))

    for no in itertools.count() if rounds is None else range(rounds):
        ins, outs = {}, {}
        for s, t, _ in arcs:
            outs[s] = outs.get(s, 0) + 1
            ins[t] = ins.get(t, 0) + 1
        full = [(n, d) for n, d in sorted(ins.items(), key=lambda x: -x[1]) if d > 1 and d + outs.get(n, 0) > most and d > most - max(1, outs.get(n, 0))]
        if full:
            node, _ = full[0]
            room = max(2, most - 1)
            mine = [x for x in arcs if x[1] == node]
            arcs = [x for x in arcs if x[1] != node]
            level, k = [(s, lab) for s, _, lab in mine], 0
            while len(level) > 1:
                nxt = []
                for i in range(0, len(level), room):
                    k += 1
                    gate = f"gw_merge_{node}_{no}_{k}"
                    added.append((gate, "Merge"))
                    for s, lab in level[i : i + room]:
                        link(s, gate, lab)
                    nxt.append((gate, ""))
                level = nxt
            link(level[0][0], node, "")
            continue
        full = [(n, d) for n, d in sorted(outs.items(), key=lambda x: -x[1]) if d > 1 and d + ins.get(n, 0) > most]
        if not full:
            break
        node, _ = full[0]
        room = max(2, most - 1)
        mine = [x for x in arcs if x[0] == node]
        arcs = [x for x in arcs if x[0] != node]
        level, k = [(t, lab) for _, t, lab in mine], 0
        while len(level) > 1:
            nxt = []
            for i in range(0, len(level), room):
                k += 1
                gate = f"gw_split_{node}_{no}_{k}"
                added.append((gate, "Split"))
                for t, lab in level[i : i + room]:
                    link(gate, t, lab)
                nxt.append((gate, ""))
            level = nxt
        link(node, level[0][0], "")
    return arcs, added


def limited_edges(e: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """``procedure_id, src, tgt, label, added``: arcs under the degree limit; ``added`` names gateways put in.

    Only procedures with a node over the limit are rewritten; one's arcs are one group, bounded by its steps.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        arcs, extra = limit_degrees(list(zip(g["src"], g["tgt"], g["label"])), most)
        names = dict(extra)
        return pd.DataFrame([(g["procedure_id"].iloc[0], s, t, lab, names.get(s, "")) for s, t, lab in arcs], columns=["procedure_id", "src", "tgt", "label", "added"])

    arcs = e.select("procedure_id", "src", "tgt", "label")
    full = degrees(arcs).where(F.col("in_degree") + F.col("out_degree") > most).select("procedure_id").distinct()
    out = arcs.join(full, "procedure_id", "left_semi").groupBy("procedure_id").applyInPandas(run, "procedure_id string, src string, tgt string, label string, added string")
    return out.unionByName(arcs.join(full, "procedure_id", "left_anti").withColumn("added", F.lit("")))


def element_line(kind, alias, description):
    """One node of the lane diagram language."""
    desc = F.coalesce(F.nullif(description, F.lit("")), F.lit("Azione"))
    out = F.when(kind == "event_start", "(start) as start").when(kind == "event_end", "(end) as end")
    for k, tag in L.EVENT_TAGS.items():
        out = out.when(kind == k, F.concat(F.lit(f"({tag} "), desc, F.lit(") as "), alias))
    for k, pre in L.GATEWAY_PREFIX.items():
        out = out.when(kind == k, F.concat(F.lit(f"<{pre}"), desc, F.lit("> as "), alias))
    out = out.when(kind.startswith("gateway_"), F.concat(F.lit("<"), desc, F.lit("> as "), alias)).when(kind == "activity_subprocess", F.concat(F.lit("[@subprocess "), desc, F.lit("] as "), alias))
    return out.otherwise(F.concat(F.lit("["), desc, F.lit("] as "), alias))


def lane_diagram(steps: DataFrame, limited: DataFrame, titles: DataFrame) -> DataFrame:
    """``procedure_id, dsl, n_nodes, n_edges, width``: lanes by agent, their steps in order with end events last, added
    gateways in the first lane, then the flows."""
    safe = steps.withColumn("desc", T.dsl_safe(F.col("description_synthetic"))).withColumn("lane", T.dsl_safe(F.col("agent"), title=True)).withColumn("alias", alias_of(F.col("type"), F.col("id")))
    node = safe.select("procedure_id", "lane", F.when(F.col("type") == "event_end", 3).otherwise(1).alias("part"), F.col("step_idx").alias("pos"), element_line(F.col("type"), F.col("alias"), F.col("desc")).alias("txt"), "alias")
    first = safe.groupBy("procedure_id").agg(F.min("lane").alias("lane"), F.max(F.col("type") == "event_start").alias("s"), F.max(F.col("type") == "event_end").alias("e"))
    mark = lambda missing, part, txt, alias: F.when(~missing, F.struct(F.lit(part).alias("part"), F.lit(txt).alias("txt"), F.lit(alias).alias("alias")))
    both = F.array(mark(F.col("s"), 0, "(start) as start", "start"), mark(F.col("e"), 4, "(end) as end", "end"))
    ends = first.select("procedure_id", "lane", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"))
    ends = ends.select("procedure_id", "lane", "x.part", F.lit(0).alias("pos"), "x.txt", "x.alias")
    extra = limited.where("added <> ''").select("procedure_id", F.col("src").alias("alias"), "added").distinct().join(first.select("procedure_id", "lane"), "procedure_id")
    gates = extra.select("procedure_id", "lane", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.when(F.trim("added") == "", F.concat(F.lit("[ ] as "), "alias")).otherwise(F.concat(F.lit("<"), "added", F.lit("> as "), "alias")).alias("txt"), "alias")
    nodes = node.unionByName(ends).unionByName(gates)
    lanes = nodes.groupBy("procedure_id", "lane").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "alias", "txt"))).alias("ns"))
    block = F.concat(F.lit("lane: "), F.col("lane"), F.lit("\n"), F.array_join(F.transform("ns", lambda x: F.concat(F.lit("    "), x.txt)), "\n"))
    body = lanes.groupBy("procedure_id").agg(F.sort_array(F.collect_list(F.struct("lane", block.alias("b")))).alias("bs"), F.sum(F.size("ns")).alias("n_nodes"))
    flow = limited.select("procedure_id", F.concat("src", F.lit("->"), "tgt", F.when(F.col("label") != "", F.concat(F.lit(": "), "label")).otherwise("")).alias("f"))
    flows = flow.groupBy("procedure_id").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    d = body.join(flows, "procedure_id", "left").join(titles, "procedure_id", "left").withColumn("n_edges", F.coalesce(F.size("fs"), F.lit(0)))
    width = F.greatest(F.lit(6500), F.least(F.lit(24000), 5000 + 240 * F.col("n_nodes") + 90 * F.col("n_edges"))).cast("int")
    dsl = F.concat_ws("\n", F.concat(F.lit("title: "), T.dsl_safe(F.col("title"), title=True)), F.concat(F.lit("width: "), width), F.lit(""), F.array_join(F.transform("bs", lambda x: x.b), "\n\n"), F.lit(""), F.array_join("fs", "\n"))
    return d.select("procedure_id", dsl.alias("dsl"), "n_nodes", "n_edges", width.alias("width"))


def dot_source(steps: DataFrame, e: DataFrame, titles: DataFrame, lanes: bool = False) -> DataFrame:
    """``procedure_id, dot``: Graphviz text with node shapes, agent colours and wrapped labels; clusters by agent if
    ``lanes``."""
    rank = F.dense_rank().over(Window.partitionBy("procedure_id").orderBy("agent")) - 1
    s = steps.withColumn("colour", T.agent_colour(rank, F.col("agent"))).withColumn("alias", alias_of(F.col("type"), F.col("id")))
    label = F.replace(T.wrap(F.col("description_synthetic"), 25 if lanes else 35), F.lit('"'), F.lit("'"))
    line = F.concat(F.lit('  "'), "alias", F.lit('" [shape='), T.node_shape(F.col("type")), F.lit(', style=filled, fillcolor="'), T.node_fill(F.col("type"), F.col("colour"), lanes), F.lit('", label="'), label, F.lit('"];'))
    n = s.select("procedure_id", "agent", "step_idx", line.alias("l"))
    virtual = e.groupBy("procedure_id").agg(F.max(F.when((F.col("src") == "start"), '  "start" [shape=circle, style=filled, fillcolor="green", label="Start"];')).alias("s"), F.max(F.when(F.col("tgt") == "end", '  "end" [shape=doublecircle, style=filled, fillcolor="red", label="End"];')).alias("t"))
    if lanes:
        per = n.groupBy("procedure_id", "agent").agg(F.sort_array(F.collect_list(F.struct("step_idx", "l"))).alias("ls"))
        cluster = F.concat(F.lit('  subgraph "cluster_'), F.replace("agent", F.lit('"'), F.lit("'")), F.lit('" {\n'), F.array_join(F.transform("ls", lambda x: x.l), "\n"), F.lit("\n  }"))
        body = per.groupBy("procedure_id").agg(F.sort_array(F.collect_list(F.struct("agent", cluster.alias("l")))).alias("ns"))
    else:
        body = n.groupBy("procedure_id").agg(F.sort_array(F.collect_list(F.struct("step_idx", "l"))).alias("ns"))
    arc = F.concat(F.lit('  "'), "src", F.lit('" -> "'), "tgt", F.lit('"'), F.when(F.col("label") != "", F.concat(F.lit(' [label="'), "label", F.lit('"]'))).otherwise(""), F.lit(";"))
    arcs = e.groupBy("procedure_id").agg(F.sort_array(F.collect_list(arc)).alias("es"))
    d = body.join(arcs, "procedure_id", "left").join(virtual, "procedure_id", "left").join(titles, "procedure_id", "left")
    dot = F.concat_ws("\n", F.concat(F.lit('digraph "'), F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit("'")), F.lit('" {')), F.lit("  rankdir=TB;"), "s", F.array_join(F.transform("ns", lambda x: x.l), "\n"), "t", F.array_join("es", "\n"), F.lit("}"))
    return d.select("procedure_id", dot.alias("dot"))


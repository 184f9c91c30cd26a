"""The evaluation of three systems against gold annotations and against each other, over all documents at once.

Lists (titles, procedures) are matched one to one by similarity, agents as sets; against gold, predicted agents are
brought to the gold names first.  All comparisons of a kind run in one plan, keyed by document and pair of sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.functions import text as T
from scrivano.operators import evaluation
from scrivano.session import cut
from scrivano.sources import files

SYSTEMS = ("rag", "no_rag_guided", "no_rag_only")
THRESHOLDS = {"titles": 0.85, "procedures": 0.70, "agents": 0.80}


def predictions(results: DataFrame) -> dict[str, DataFrame]:
    """``titles, procedures (doc, system, idx, text)``, ``agents (doc, system, agent)`` and ``procedure_agents (doc,
    system, idx, agent)`` of ``files.read_results``; blank ones are left out, agents are normalised and distinct."""
    r = results.where("result is not null")
    t = r.select("doc", "system", F.posexplode("result.outline").alias("idx", "t")).select("doc", "system", "idx", T.strip(F.col("t.title")).alias("text")).where("text <> ''")
    # procedures without diagrams carry their own text, if any
    own = F.transform("result.procedures", lambda p: F.struct(F.coalesce(p.text, p.original_text).alias("original_text_full"), F.array().cast("array<struct<agent:string>>").alias("steps")))
    ps = F.when(F.size("result.diagram_procedures") > 0, F.col("result.diagram_procedures")).otherwise(own)
    p = r.select("doc", "system", F.posexplode(ps).alias("idx", "p")).select("doc", "system", "idx", T.strip(F.col("p.original_text_full")).alias("text"), "p.steps")
    a = p.select("doc", "system", "idx", F.explode("steps").alias("s")).select("doc", "system", "idx", T.normalize_agent(F.col("s.agent")).alias("agent")).where("agent <> ''").distinct()
    return {"titles": t, "procedures": p.where("text <> ''").drop("steps"), "agents": a.select("doc", "system", "agent").distinct(), "procedure_agents": a}


KEY = "\x1f"


def _keyed(df: DataFrame, first, second) -> DataFrame:
    return df.withColumn("key", F.concat_ws(KEY, "doc", first, second))


def _list_metrics(ref: DataFrame, pred: DataFrame, block: str) -> DataFrame:
    m = evaluation.match_lists(ref, pred, block == "titles", THRESHOLDS[block])
    b = evaluation.block_metrics(ref, pred, cut(m))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return b.select("key", F.lit(block).alias("block"), "tp", "fp", "fn", "precision", "recall", "f1", F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(0.0).alias("jaccard"))


def _set_metrics(ref: DataFrame, pred: DataFrame) -> DataFrame:
    m = evaluation.set_prf(ref.select("key", F.col("agent").alias("item")), pred.select("key", F.col("agent").alias("item")), ["key"])
    return m.select("key", F.lit("agents").alias("block"), "tp", "fp", "fn", "precision", "recall", "f1", "jaccard")


def metrics(pred: dict[str, DataFrame], gold: dict[str, DataFrame] | None = None) -> DataFrame:
    """``doc, kind, first, second, block, tp, fp, fn, precision, recall, f1, jaccard``.

    ``kind`` is 'pairwise' (both sides systems that have a result) or 'gold_vs' (``first`` 'gold').  ``gold`` has
    ``titles, procedures (doc, idx, text)`` and ``agents (doc, group_id, alias)``; a block without gold for a document
    gives no row, a pair in which both sides are empty gives none either.
    """
    sides = cut(pred["titles"].select("doc", "system").unionByName(pred["procedures"].select("doc", "system")).unionByName(pred["agents"].select("doc", "system")).distinct())
    pairs = evaluation.pair_systems(sides.withColumnRenamed("doc", "doc_id"), SYSTEMS).withColumnRenamed("doc_id", "doc")
    parts = []

    def two(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        a = df.join(pairs.withColumn("system", F.col("first")), ["doc", "system"])
        b = df.join(pairs.withColumn("system", F.col("second")), ["doc", "system"])
        return _keyed(a, "first", "second"), _keyed(b, "first", "second")

    for block in ("titles", "procedures"):
        parts.append(_list_metrics(*two(pred[block]), block))
    parts.append(_set_metrics(*two(pred["agents"])))
    if gold:
        for block in ("titles", "procedures"):
            g = gold[block].select("doc", "idx", "text")
            have = g.select("doc").distinct()
            parts.append(_list_metrics(_keyed(g.join(sides, "doc"), F.lit("gold"), "system"), _keyed(pred[block].join(have, "doc", "left_semi"), F.lit("gold"), "system"), block))
        parts.append(_gold_agents(gold["agents"], pred["agents"], sides))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    k = F.split("key", KEY)
    return out.select(k[0].alias("doc"), F.when(k[1] == "gold", "gold_vs").otherwise("pairwise").alias("kind"), k[1].alias("first"), k[2].alias("second"), *[c for c in out.columns if c != "key"])


def _gold_agents(aliases: DataFrame, agents: DataFrame, sides: DataFrame) -> DataFrame:
    """Gold names as a set against predicted agents brought to them, document by document."""
    a = aliases.select("doc", F.struct("doc", "group_id").alias("group_id"), "alias")
    names = a.groupBy("doc", "group_id").agg(F.min(F.struct(F.length("alias").alias("n"), F.col("alias").alias("a"))).alias("m")).select("doc", F.col("m.a").alias("agent")).distinct()
    mine = agents.join(names.select("doc").distinct(), "doc", "left_semi")
    canon = evaluation.canonicalize_by_key(mine.select(F.col("doc").alias("key"), "agent").distinct(), a.withColumnRenamed("doc", "key"), THRESHOLDS["agents"])
    pred = mine.join(canon.withColumnRenamed("key", "doc"), ["doc", "agent"]).select("doc", "system", F.col("canonical").alias("agent")).distinct()
    return _set_metrics(_keyed(names.join(sides, "doc"), F.lit("gold"), "system"), _keyed(pred, F.lit("gold"), "system"))


def aggregate(m: DataFrame) -> DataFrame:
    """Means over documents: ``kind, first, second, block, metric, mean, documents``."""
    long = m.select("kind", "first", "second", "block", F.explode(F.create_map(*[x for c in ("precision", "recall", "f1", "jaccard") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    return evaluation.macro_average(long, ["kind", "first", "second", "block", "metric"])


def agents_by_procedure(gold: DataFrame, gold_agents: DataFrame, pred: DataFrame, pred_agents: DataFrame) -> DataFrame:
    """Per document and system the mean precision, recall and F1 of agents over matched procedures: ``doc, system,
    matches, precision, recall, f1``.

    ``gold(doc, idx, text)``, ``gold_agents(doc, proc_idx, agent)``, ``pred(doc, system, idx, text)``, ``pred_agents(doc,
    system, idx, agent)``.  Only documents whose gold has agents for as many procedures as it has texts count.
    """
    n = gold.groupBy("doc").agg(F.count("*").alias("n"))
    full = gold_agents.groupBy("doc").agg((F.max("proc_idx") + 1).alias("m")).join(n, "doc").where("n = m").select("doc")
    sides = pred.select("doc", "system").distinct().join(full, "doc", "left_semi")
    ref = _keyed(gold.join(sides, "doc"), F.lit("gold"), "system")
    got = cut(evaluation.match_lists(ref, _keyed(pred.join(full, "doc", "left_semi"), F.lit("gold"), "system"), False, THRESHOLDS["procedures"]))
    k = F.split("key", KEY)
    got = got.select(k[0].alias("doc"), k[2].alias("system"), "ref_idx", "pred_idx")
    pair = F.concat_ws(KEY, "doc", "system", "ref_idx")
    g = got.join(gold_agents.withColumnRenamed("proc_idx", "ref_idx"), ["doc", "ref_idx"]).select(pair.alias("key"), F.col("agent").alias("item"))
    p = got.join(pred_agents.withColumnRenamed("idx", "pred_idx"), ["doc", "system", "pred_idx"]).select(pair.alias("key"), F.col("agent").alias("item"))
    each = got.select("doc", "system", pair.alias("key")).join(evaluation.set_prf(g, p, ["key"]), "key", "left").fillna(0.0, ["precision", "recall", "f1"])
    return each.groupBy("doc", "system").agg(F.count("*").alias("matches"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def summary_file(m: DataFrame, out_name: str = "evaluation_summary.json") -> DataFrame:
    """``path, content`` of the summary: documents with their metrics, and the means."""
    block = F.struct("kind", "first", "second", "block", "tp", "fp", "fn", "precision", "recall", "f1", "jaccard")
    docs = m.groupBy("doc").agg(F.sort_array(F.collect_list(block)).alias("metrics"))
    one = docs.agg(F.count("*").alias("docs_evaluated"), F.sort_array(F.collect_list(F.struct("doc", "metrics"))).alias("docs"))
    mean = aggregate(m).agg(F.sort_array(F.collect_list(F.struct("kind", "first", "second", "block", "metric", "mean", "documents"))).alias("aggregate"))
    limits = F.struct(*[F.lit(v).alias(k) for k, v in THRESHOLDS.items()])
    both = one.crossJoin(mean)  # one row each
    return both.select(F.lit(out_name).alias("path"), files.as_json(F.struct("docs_evaluated", limits.alias("thresholds"), "aggregate", "docs")).alias("content"))


def run(spark, root: str, gold: dict[str, DataFrame] | None = None) -> DataFrame:
    """Evaluates the results below ``root`` and writes the summary there; returns the metrics."""
    m = cut(metrics(predictions(files.read_results(spark, root)), gold))
    written = files.write_files(summary_file(m), root).collect()  # one row
    if written[0]["error"]:
        raise OSError(written[0]["error"])
    return m

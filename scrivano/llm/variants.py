"""Variant spellings of names: metric-space partitioning and exact edit-distance joins inside each cell.

Every distinct normalised name ("form") of a document is a set of points in spaces of strings: its spelling run
together (``full``, radius 4: words run together or split), its words (``any``, radius 0, and for the slips that
``names.typo`` allows ``slip``, radius 4 with at most two foreign letters: slips, other order, dropped and abbreviated
words beside one written out), and its initials as they stand and sorted (``init`` and ``sort``, radius 0: acronyms and
names abbreviated throughout).  In each space, a set of more than ``CELL`` points gets about sqrt(n) pivots; a point goes
to the cell of its nearest pivot and, by the triangle inequality, to every cell whose pivot is within that distance plus
twice the radius; inside a cell the points within the radius are joined by their exact Levenshtein distance.  Only forms
that meet in some space are candidates, and every pair that ``names.compare`` accepts does.  Candidates are verified word
by word; certain links form entities, uncertain ones (initials, acronyms, pet names, dropped words) are kept where one
entity only fits best.

A document of at most ``GATHER`` rows is linked in one Arrow pass (``link_forms``); for larger ones the same spaces are
joined as tables (``candidates``, ``components``), so that no document is gathered in one task whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm import names as N
from scrivano.llm.components import components
from scrivano.llm.metric import radius_join
from scrivano.session import cut, maybe_broadcast

RADIUS, CELL, SALTS, GATHER = 4, 64, 16, 500
SLIP = 2  # letters that one of two slipped words has and the other lacks
POINTS = "form string, pts array<string>, slips array<struct<g:int,w:string>>"
COMPARED = "same int, cost double, low boolean"
#: uncertain links by cost: words cut short, again with what they merged, then the rest
WEAK = ((0.0, 0.55), (0.0, 0.55), (0.0, 9.0))


def _points(name: pd.Series) -> pd.DataFrame:
    out = [(N.form(n), [f"{a}:{b}" for a, b in N.keys(n)], N.slips(n)) for n in map(N.parse, name)]
    return pd.DataFrame(out, columns=["form", "pts", "slips"])


def _remainders(word: pd.Series) -> pd.Series:
    return word.map(N.remainders)


def _compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(a, b):
        nx, ny = N.unform(x), N.unform(y)
        v = N.compare(nx, ny)
        out.append((v.same, v.cost, _detail(nx) < _detail(ny)))
    return pd.DataFrame(out, columns=["same", "cost", "low"])


def _detail(n: N.Name) -> tuple:
    """How much a spelling says: words written out, then words, then letters."""
    return (sum(not d and len(t) > 1 for t, d in zip(n.tokens, n.abbr)), len(n.tokens), sum(map(len, n.tokens)))


# ---- documents of bounded size: one pass ---------------------------------------------------------------------------


def near_forms(forms: list[str], radius: int = RADIUS, cell: int = CELL) -> set[tuple[int, int]]:
    """Positions i < j of the forms that meet in some space."""
    spaces: dict[str, dict[str, list[int]]] = {}
    for i, f in enumerate(forms):
        n = N.unform(f)
        for kind, key in N.keys(n):
            spaces.setdefault(kind, {}).setdefault(key, []).append(i)
        for _, w in N.slips(n):
            at = spaces.setdefault("slip", {}).setdefault(w, [])
            if not at or at[-1] != i:
                at.append(i)
    found: set[tuple[int, int]] = set()

    def meet(xs: list[int], ys: list[int]) -> None:
        found.update((x, y) if x < y else (y, x) for x in xs for y in ys if x != y)

    for kind, points in spaces.items():
        for xs in points.values():
            if len(xs) > 1 and kind != "slip":
                meet(xs, xs)
        if kind in ("full", "slip"):
            keys = list(points)
            for i, j in radius_join(keys, radius, cell, SLIP if kind == "slip" else None):
                meet(points[keys[i]], points[keys[j]])
    return found


def _roots(edges: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Least node each node of the edges is connected to."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(up)}


@lru_cache(maxsize=2_000)
def link_forms(forms: tuple[str, ...]) -> dict[str, str]:
    """Entity of the forms of one document that are linked to others; the least form of each entity names it."""
    judged = []
    for i, j in near_forms(list(forms)):
        a, b = (forms[i], forms[j]) if forms[i] < forms[j] else (forms[j], forms[i])
        na, nb = N.unform(a), N.unform(b)
        v = N.compare(na, nb)
        if v.same:
            judged.append((a, b, v, _detail(na) < _detail(nb)))
    label = _roots((a, b) for a, b, v, _ in judged if v.same == 2)
    for low, high in WEAK:
        best: dict[str, dict[str, float]] = {}
        for a, b, v, less in judged:
            if v.same == 1 and low <= v.cost < high:
                short, long = (a, b) if less else (b, a)
                own, ent = label.get(short, short), label.get(long, long)
                if own != ent:
                    costs = best.setdefault(own, {})
                    costs[ent] = min(costs.get(ent, 99.0), round(v.cost, 3))
        one = [(own, [e for e, c in costs.items() if c == min(costs.values())]) for own, costs in best.items()]
        merged = _roots((own, ents[0]) for own, ents in one if len(ents) == 1)
        label = {x: merged.get(y, y) for x, y in label.items()} | {x: y for x, y in merged.items() if x not in label}
    return label


def entities(names: pd.Series) -> pd.Series:
    """Arrays of names of one document each to the entities of the names, null for blank names and fillers."""
    out = []
    for doc in names:
        forms = [N.form(N.parse(x)) if x is not None and x.strip() else "" for x in doc]
        label = link_forms(tuple(sorted(set(forms) - {""})))
        out.append([label.get(f, f) or None for f in forms])
    return pd.Series(out)


def linked_arrays(names):
    """Column of entities for a column of arrays of names (of bounded size)."""
    return F.pandas_udf(entities, "array<string>")(names)


def large_documents(rows: DataFrame, gather: int = GATHER) -> DataFrame:
    """``doc_id`` of the documents of more than ``gather`` rows."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > gather).select("doc_id")


# ---- documents of any size: as tables ------------------------------------------------------------------------------


def metric_pairs(points: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """All pairs of ``points(doc_id, key, form)`` of one document whose keys are within ``radius`` edits.

    Returns distinct ``(doc_id, a, b)`` forms with a < b.  Null keys are ignored; equal keys of different forms pair.
    """
    pts = points.where("key is not null and doc_id is not null").select("doc_id", "key", "form").distinct()
    size = pts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    pts = pts.join(size, "doc_id")
    small = pts.where(F.col("n") <= cell).select("doc_id", F.lit("").alias("cell"), "key", "form")
    big = pts.where(F.col("n") > cell)
    pivots = (
        big.where((F.col("key") == F.col("least")) | (F.pmod(F.xxhash64("doc_id", "key"), F.ceil(F.sqrt("n"))) == 0))
        .select("doc_id", F.col("key").alias("pivot"))
        .distinct()
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    assigned = (
        big.select("doc_id", "key", "form", F.pmod(F.xxhash64("key", "form"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(pivots, ["doc_id", "salt"])
        .groupBy("doc_id", "key", "form")
        .agg(F.collect_list(F.struct(F.levenshtein("key", "pivot").alias("d"), F.col("pivot").alias("p"))).alias("ds"))
        .withColumn("near", F.array_min("ds").getField("d"))
        .select("doc_id", "key", "form", F.explode(F.filter("ds", lambda x: x.d <= F.col("near") + 2 * radius)).alias("x"))
        .select("doc_id", F.col("x.p").alias("cell"), "key", "form")
    )
    cells = small.unionByName(assigned)
    a = cells.select("doc_id", "cell", F.col("key").alias("ka"), F.col("form").alias("a"))
    b = cells.select("doc_id", "cell", F.col("key").alias("kb"), F.col("form").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("ka") - F.length("kb")) <= radius) & (F.levenshtein("ka", "kb", radius) >= 0)
    return a.join(b, ["doc_id", "cell"]).where(near).select("doc_id", "a", "b").distinct()


def candidates(forms: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """All pairs of ``forms(doc_id, form, pts, slips)`` of one document that ``names.compare`` could accept.

    Returns distinct ``(doc_id, a, b)`` with a < b.
    """
    pts = forms.select("doc_id", "form", F.explode("pts").alias("p"))
    full = pts.where(F.col("p").startswith("full:")).select("doc_id", "form", F.expr("substring(p, 6)").alias("key"))
    size = forms.groupBy("doc_id").agg(F.count("*").alias("n"))
    slips = forms.select("doc_id", "form", F.explode("slips").alias("x")).select("doc_id", "form", "x.*").join(size, "doc_id")
    left = slips.where(F.col("n") > cell).withColumn("r", F.explode(F.pandas_udf(_remainders, "array<string>")("w")))
    exact = pts.where(~F.col("p").startswith("full:")).select("doc_id", "form", F.col("p").alias("key")).unionByName(
        left.select("doc_id", "form", F.concat_ws(":", F.lit("slip"), "g", "r").alias("key")).distinct()
    )
    ea, eb = exact.withColumnRenamed("form", "a"), exact.withColumnRenamed("form", "b")
    same_key = ea.join(eb, ["doc_id", "key"]).where("a < b").select("doc_id", "a", "b")
    small = slips.where(F.col("n") <= cell)
    sa = small.select("doc_id", "g", F.col("form").alias("a"), F.col("w").alias("wa"))
    sb = small.select("doc_id", "g", F.col("form").alias("b"), F.col("w").alias("wb"))
    # within two edits neither word has more than two letters that the other lacks
    near = "a < b and wa <> wb and abs(length(wa) - length(wb)) <= 2 and length(translate(wa, wb, '')) <= 2 and length(translate(wb, wa, '')) <= 2"
    slipped = sa.join(sb, ["doc_id", "g"]).where(near).where(F.levenshtein("wa", "wb", 4) >= 0).select("doc_id", "a", "b")
    return metric_pairs(full, radius, cell).unionByName(same_key).unionByName(slipped).distinct()


def link_names(rows: DataFrame, radius: int = RADIUS, cell: int = CELL, gather: int = GATHER) -> DataFrame:
    """Entities of names within documents.

    ``rows(doc_id, name)`` may repeat; null documents and null or blank names are dropped, other columns ignored.
    Returns distinct ``(doc_id, name, entity)``; fillers ("n.d.", "altri") have a null entity.  An empty input gives
    no rows.  ``gather`` only says which of two equal ways a document takes.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("name").rlike(r"(?U)\S")).select("doc_id", "name")
    large = cut(large_documents(rows, gather))
    if large.isEmpty():
        return _link_gathered(rows)
    large = maybe_broadcast(large)
    return _link_gathered(rows.join(large, "doc_id", "left_anti")).unionByName(_link_tables(rows.join(large, "doc_id", "left_semi"), radius, cell))


def _link_gathered(rows: DataFrame) -> DataFrame:
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return docs.select("doc_id", F.explode(F.arrays_zip("names", linked_arrays(F.col("names")).alias("e"))).alias("x")).select(
        "doc_id", F.col("x.names").alias("name"), F.col("x.e").alias("entity")
    )


def _link_tables(rows: DataFrame, radius: int, cell: int) -> DataFrame:
    named = cut(rows.distinct().withColumn("x", F.pandas_udf(_points, POINTS)("name")).select("doc_id", "name", "x.*"))
    forms = named.where("form <> ''").select("doc_id", "form", "pts", "slips").dropDuplicates(["doc_id", "form"])
    judged = candidates(forms, radius, cell).withColumn("v", F.pandas_udf(_compare, COMPARED)("a", "b")).select("doc_id", "a", "b", "v.*").where("same > 0")
    judged = cut(judged)
    label = components(judged.where("same = 2").select("doc_id", "a", "b"))
    for low, high in WEAK:
        weak = judged.where((F.col("same") == 1) & (F.col("cost") >= low) & (F.col("cost") < high))
        roots = components(_resolve(weak, label))
        merged = roots.select("doc_id", F.col("node").alias("label"), F.col("label").alias("root"))
        alone = merged.select("doc_id", F.col("label").alias("node"), F.col("label")).join(label, ["doc_id", "node"], "left_anti")
        label = cut(label.unionByName(alone).join(merged, ["doc_id", "label"], "left").select("doc_id", "node", F.coalesce("root", "label").alias("label")), label, roots)
    found = label.select("doc_id", F.col("node").alias("form"), "label")
    return named.join(found, ["doc_id", "form"], "left").select(
        "doc_id", "name", F.when(F.col("form") != "", F.coalesce("label", "form")).alias("entity")
    )


def _resolve(weak: DataFrame, label: DataFrame) -> DataFrame:
    """Of the uncertain links of a less telling spelling keep those to its one best-fitting entity."""
    w = weak.select(
        "doc_id", F.when(F.col("low"), F.col("a")).otherwise(F.col("b")).alias("short"),
        F.when(F.col("low"), F.col("b")).otherwise(F.col("a")).alias("long"), F.round("cost", 3).alias("cost"),
    )
    lab = label.select("doc_id", F.col("node").alias("long"), "label")
    own = label.select("doc_id", F.col("node").alias("short"), F.col("label").alias("own"))
    w = w.join(lab, ["doc_id", "long"], "left").join(own, ["doc_id", "short"], "left")
    w = w.withColumn("ent", F.coalesce("label", "long")).withColumn("own", F.coalesce("own", "short")).where("ent <> own")
    best = w.groupBy("doc_id", "own", "ent").agg(F.min(F.struct("cost", "short", "long")).alias("m"))
    top = best.groupBy("doc_id", "own").agg(F.min("m.cost").alias("least"))
    best = best.join(top, ["doc_id", "own"]).where(F.col("m.cost") == F.col("least"))
    one = best.groupBy("doc_id", "own").agg(F.count("*").alias("n"), F.first("ent").alias("ent")).where("n = 1")
    return one.select("doc_id", F.col("own").alias("a"), F.col("ent").alias("b"))


def variant_pairs(linked: DataFrame) -> DataFrame:
    """Every pair of different spellings of one entity, ``name_a`` < ``name_b``."""
    m = linked.where("entity is not null").select("doc_id", "entity", "name").distinct()
    a, b = m.withColumnRenamed("name", "name_a"), m.withColumnRenamed("name", "name_b")
    return a.join(b, ["doc_id", "entity"]).where("name_a < name_b").select("doc_id", "name_a", "name_b")


def typed_names(definitions_raw: DataFrame, prompt_blocks: DataFrame) -> DataFrame:
    return definitions_raw.select("doc_id", F.col("term").alias("name")).unionByName(
        prompt_blocks.select("doc_id", F.explode("allowed_agents").alias("name"))
    )

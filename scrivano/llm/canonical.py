"""Free-entered values mapped to a reference list.

Values are deduplicated and normalised to forms (``names.parse``).  Entries and forms are sets of character 3-grams of
their words and a feature for the initials, weighted by inverse document frequency over the list; initials weigh double.
Candidates come from an inverted index of the entries' features: all entries that share a feature with a form get their
weighted cosine by adding up its postings, and those at or above ``threshold`` are candidates.  They are taken from the
best cosine down and verified word by word (``names.compare``: a body that only resembles an entry is not that entry);
the best one verified is accepted if no other verified entry comes within ``margin`` of its cosine.  The list is taken
in blocks of bounded size against all forms, so neither a common feature nor a long list makes a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm import names as N
from scrivano.session import cut, maybe_broadcast

THRESHOLD, MARGIN, INITIALS, BLOCK = 0.25, 0.04, 2.0, 20_000


def grams(n: N.Name) -> list[str]:
    """3-grams of the padded words, and the initials as one feature."""
    if n.filler:
        return []
    if n.acronym:
        return ["#" + n.acronym]
    out = {f" {t} "[i : i + 3] for t in n.tokens for i in range(len(t))}
    if len(n.tokens) > 2:
        out.add("#" + "".join(t[0] for t in n.tokens))
    if len(n.tokens) <= 2 and 3 <= len(n.tokens[-1]) <= 8:
        out.add("#" + n.tokens[-1])
    return sorted(out)


def _features(name: pd.Series) -> pd.DataFrame:
    out = [(N.form(n), grams(n)) for n in map(N.parse, name)]
    return pd.DataFrame(out, columns=["form", "grams"])


@lru_cache(maxsize=30_000)
def _entry(name: str) -> tuple[N.Name, str]:
    n = N.parse(name)
    return n, "".join(t[0] for t in n.tokens)


class Index:
    """Inverted index of a block of entries ``(id, name, acronym, gs, ws)``."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.names = rows["id"].tolist(), rows["name"].tolist()
        self.acronyms = [a or "" for a in rows["acronym"]]
        self.listed = set(self.acronyms) - {""}
        self.norms = np.array([max(1e-9, float(np.sqrt(np.square(w).sum()))) for w in rows["ws"]])
        postings: dict[str, list[int]] = {}
        for k, gs in enumerate(rows["gs"]):
            for g in gs:
                postings.setdefault(g, []).append(k)
        self.postings = {g: np.array(ks, np.int32) for g, ks in postings.items()}

    def cosines(self, gs, ws) -> np.ndarray:
        acc = np.zeros(len(self.ids))
        for g, w in zip(gs, ws):
            ks = self.postings.get(g)
            if ks is not None:
                acc[ks] += w * w
        return acc / (self.norms * max(1e-9, float(np.sqrt(np.square(ws).sum()))))


def _fits(n: N.Name, e: N.Name, initials: str, acr: str) -> bool:
    """Names the value the entry for certain, or as a spelling cut short that no full one contradicts?"""
    v = N.compare(n, e)
    return v.same == 2 or (v.same == 1 and (v.cost < 0.65 or bool(acr) and acr == initials))


def _judge(index: Index, threshold: float, margin: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, gs, ws in zip(b["form"], b["gs"], b["ws"]):
                n, cos = N.unform(f), index.cosines(gs, ws)
                acr = n.acronym or (n.tokens[-1] if len(n.tokens) <= 2 and n.tokens and len(n.tokens[-1]) <= 8 else "")
                # a listed acronym goes before mere initials
                listed = acr in index.listed and bool(n.acronym or len(n.tokens) == 1)
                best = None
                at = np.flatnonzero(cos >= threshold)
                for k in at[np.lexsort((np.array(index.ids)[at], -cos[at]))]:
                    if best is not None and cos[k] <= best - margin:
                        break
                    if index.acronyms[k] == acr if listed else _fits(n, *_entry(index.names[k]), acr):
                        out.append((f, index.ids[k], float(cos[k]), listed))
                        best = cos[k] if best is None else best
            yield pd.DataFrame(out, columns=["form", "id", "cos", "listed"])

    return run


def _weighted(features: DataFrame, idf: DataFrame, top) -> DataFrame:
    """``features(key columns, g)`` with each key's features and weights as arrays ``gs`` and ``ws``."""
    keys = [c for c in features.columns if c != "g"]
    w = F.coalesce("w", top) * F.when(F.col("g").startswith("#"), INITIALS).otherwise(1.0)
    return features.join(maybe_broadcast(idf), "g", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", w.alias("w")))).alias("f")).select(*keys, F.col("f.g").alias("gs"), F.col("f.w").alias("ws"))


def map_values(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """``values(value)`` against ``entries(id, name, acronym)``.

    Returns one row per distinct non-null value: ``(value, id, score, rivals)`` with a null id where nothing fits;
    ``score`` is the weighted cosine of the best verified entry (0 without one), ``rivals`` how many verified entries
    come within ``margin`` of it, itself counted.  A value that is literally an entry maps to it with score 1.  Blank
    values and fillers come out unmatched.  Entries with a null name are ignored, repeated entries count once, the least
    id winning.  An empty list maps nothing.  ``block`` says how many entries are taken at a time.
    """
    entries = entries.where("name is not null").groupBy("name").agg(F.min("id").alias("id"), F.lower(F.min("acronym")).alias("acronym"))
    feats = F.pandas_udf(_features, "form string, grams array<string>")
    vals = cut(values.where("value is not null").select("value").distinct().withColumn("x", feats("value")).select("value", "x.*"))
    own = F.when(F.col("acronym") != "", F.array(F.concat(F.lit("#"), "acronym"))).otherwise(F.array().cast("array<string>"))
    e = cut(entries.withColumn("x", feats("name")).select("id", "name", "acronym", F.explode(F.array_distinct(F.concat("x.grams", own))).alias("g")))
    total = e.select("id", "name").distinct().count()
    idf = e.groupBy("g").agg(F.log(1 + F.lit(total) / F.count("*")).alias("w"))
    top = F.log(F.lit(1.0 + max(total, 1)))  # the weight of a feature no entry has
    forms = _weighted(vals.where("form <> ''").select("form", "grams").dropDuplicates(["form"]).select("form", F.explode("grams").alias("g")), idf, top)
    indexed = _weighted(e, idf, top)
    blocks = max(1, -(-total // block))
    if blocks > 1:
        forms, indexed = cut(forms), cut(indexed)
    found = None
    for k in range(blocks):
        part = Index(indexed.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).toPandas())  # about ``block`` entries
        one = forms.mapInPandas(_judge(part, threshold, margin), "form string, id long, cos double, listed boolean")
        found = one if found is None else found.unionByName(one)
    # blocks each give their best and what comes within the margin of it
    ranked = found.groupBy("form").agg(F.array_sort(F.collect_list(F.struct((~F.col("listed")).alias("plain"), (-F.col("cos")).alias("minus"), "id"))).alias("r"))
    near = F.filter("r", lambda x: (x.plain == F.col("r")[0].plain) & (x.minus < F.col("r")[0].minus + margin))
    judged = ranked.select("form", F.col("r")[0].id.alias("first"), (-F.col("r")[0].minus).alias("score"), F.size(near).alias("rivals"))
    literal = entries.select(F.col("name").alias("value"), F.col("id").alias("lit"))
    return (
        vals.join(judged, "form", "left")
        .join(maybe_broadcast(literal), "value", "left")
        .select(
            "value", F.coalesce("lit", F.when(F.col("rivals") == 1, F.col("first"))).alias("id"),
            F.when(F.col("lit").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.coalesce("rivals", F.lit(0)).alias("rivals"),
        )
    )


def typed_agents(definitions_normalized: DataFrame, prompt_blocks: DataFrame) -> DataFrame:
    """Every typed agent name with where it stands: ``(field, row_id, pos, value)``; repeated rows count once."""
    dn, pb = definitions_normalized, prompt_blocks
    one = dn.select(F.lit("canonical_agent").alias("field"), F.col("norm_id").alias("row_id"), F.lit(0).alias("pos"), F.col("canonical_agent").alias("value"))
    two = dn.select(F.lit("aliases").alias("field"), F.col("norm_id").alias("row_id"), F.posexplode("aliases").alias("pos", "value"))
    three = pb.select(F.lit("allowed_agents").alias("field"), F.col("block_id").alias("row_id"), F.posexplode("allowed_agents").alias("pos", "value"))
    return one.unionByName(two).unionByName(three).where(F.col("value").rlike(r"(?U)\S")).distinct()


def map_typed_agents(definitions_normalized: DataFrame, prompt_blocks: DataFrame, registry: DataFrame) -> DataFrame:
    rows = typed_agents(definitions_normalized, prompt_blocks)
    entries = registry.select(F.col("agent_id").cast("long").alias("id"), F.col("canonical_agent").alias("name"), "acronym")
    return rows.join(map_values(rows.select("value"), entries), "value")

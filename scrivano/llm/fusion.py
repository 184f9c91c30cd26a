"""Best representative of each group of duplicate records: Bayesian fusion with copy detection.

Records of one document whose terms are spellings of one name (``variants``) form a group; the definitions they give are
claims, and each distinct claim of a group is whole or not, which is what fusion finds out.  Evidence of a claim is its
form (too short to define anything, no end of sentence, a sentence twice, a beginning that another claim of the group
carries on), and the sources (``variant``) that make it.  Nothing of this is a verdict by itself: how often whole and
false claims show each form, how accurate each source is, and how far two sources depend on each other (false claims
they share more often than chance) are estimated together with the posteriors, round by round, over all groups.  A
source's vote loses what it may have copied from better ones.  The posterior then chooses: a claim is whole from
``WHOLE`` on, and the group's definition is the latest record that makes a whole claim, as TESTDATA.md asks.

``term`` and ``line_no`` have rules of their own in TESTDATA.md (trust, existence of the line); ``field_posteriors``
fuses them as claims too, beside the rule.

Documents of bounded size (``variants.GATHER`` rows) are linked and grouped behind one shuffle by document; those of
larger ones are aggregated by group and claim as tables.  Rounds run on claims counted by form and set of sources.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.variants import GATHER, large_documents, link_names, linked_arrays
from scrivano.session import cut, drop, maybe_broadcast

ROUNDS, COPY, FALSE_VALUES, WHOLE, WORDS, RARE = 5, 0.8, 10.0, 0.5, 4, 0.001
FORMS = ("short", "open", "doubled", "continued")

_SENTENCE = re.compile(r"(?<=[.;!?])\s+")
_CLOSED = re.compile(r"(?:[.!?]|[»\")])$")
_BREAK = re.compile(r"(?<=[.!?»\")]) ")
CLAIM = "v long, short boolean, open boolean, doubled boolean, heads array<long>"


def claim_of(text: str | None) -> tuple:
    """A definition as a claim: its hash, its form, and the hashes of the beginnings of it that look complete."""
    t = " ".join((text or "").split())
    if not t:
        return None, True, True, False, []
    parts = _BREAK.split(t)
    state, heads = xxhash.xxh64(), []
    for k, part in enumerate(parts):
        state.update(part if k == 0 else " " + part)
        heads.append(state.intdigest() - (1 << 63))
    said = [s for s in (x.strip().lower() for x in _SENTENCE.split(t)) if len(s) > 12]
    open_ = not _CLOSED.search(t) or t.endswith("...")
    return heads[-1], len(re.findall(r"[^\W_]+", t)) < WORDS, open_, len(set(said)) < len(said), heads[:-1]


def _claims(definition: pd.Series) -> pd.DataFrame:
    v, *rest = zip(*map(claim_of, definition)) if len(definition) else [()] * 5
    return pd.DataFrame({"v": pd.array(v, "Int64")} | dict(zip(("short", "open", "doubled", "heads"), map(list, rest))))


def prepare(records: DataFrame) -> DataFrame:
    """Adds the claim of the ``definition`` (``v, short, open, doubled, heads``) and its source ``src``."""
    return records.withColumn("c", F.pandas_udf(_claims, CLAIM)("definition")).select("*", "c.*", F.coalesce("variant", F.lit("")).alias("src")).drop("c")


def by_claim(records: DataFrame) -> DataFrame:
    """Prepared records with ``late, trust, line_no, line_ok, term`` aggregated by group and claim."""
    late = F.col("late")
    return records.groupBy("doc_id", "entity", "v").agg(
        *[F.first(c).alias(c) for c in ("short", "open", "doubled", "heads")],
        F.array_sort(F.collect_set("src")).alias("s"), F.count("*").alias("n"), F.min("def_id").alias("lo"), F.max("def_id").alias("hi"), F.max(late).alias("late"),
        F.max(F.struct((-F.coalesce("trust", F.lit(1 << 30))).alias("k"), late.alias("l"))).alias("t"),
        F.max(F.when(F.col("line_ok"), late)).alias("line"),
    )


def _complete():
    return ~F.col("short") & ~F.col("open") & ~F.col("doubled")


def continued_gathered(claims: DataFrame) -> DataFrame:
    """Adds ``continued``, groups being of bounded size."""
    w = Window.partitionBy("doc_id", "entity")
    heads = F.flatten(F.collect_list(F.when(_complete(), F.col("heads"))).over(w))
    return claims.withColumn("continued", F.coalesce(F.array_contains(heads, F.col("v")), F.lit(False)))


def continued_tables(claims: DataFrame) -> DataFrame:
    """The same for groups of any size."""
    heads = claims.where(_complete()).select("doc_id", "entity", F.explode("heads").alias("v")).distinct().withColumn("continued", F.lit(True))
    return claims.join(heads, ["doc_id", "entity", "v"], "left").withColumn("continued", F.coalesce("continued", F.lit(False)))


# ---- the model -----------------------------------------------------------------------------------------------------


class Model(NamedTuple):
    whole: dict[tuple[bool, ...], float]  # how often a whole claim shows these forms and no others
    false: dict[tuple[bool, ...], float]  # and a false one
    accuracy: dict[str, float]
    dependence: dict[tuple[str, str], float]


PLAIN = (False,) * len(FORMS)
SHOWN = [tuple(x) for x in itertools.product((False, True), repeat=len(FORMS))]
#: where the rounds begin: whole claims rarely show a form, false ones any
START = Model({k: 1.0 if k == PLAIN else RARE for k in SHOWN}, {k: 0.2 if k == PLAIN else 0.8 / (len(SHOWN) - 1) for k in SHOWN}, {}, {})


def vote_of(sources: Iterable[str], accuracy: dict[str, float], dependence: dict[tuple[str, str], float], values: float = FALSE_VALUES) -> float:
    """Joint vote of the sources that make one claim: a source's vote loses what it may have copied from better ones,
    and every source but the best speaks the more for the claim the more ``values`` there are to err by."""
    total = 0.0
    ranked = sorted(sources, key=lambda x: (-accuracy.get(x, 0.8), x))
    for k, x in enumerate(ranked):
        a, keep = accuracy.get(x, 0.8), 1.0
        for y in ranked[:k]:
            keep *= max(0.01, 1 - COPY * dependence.get((x, y), 0.0))
        total += keep * math.log((values if k else 1.0) * a / (1 - a))
    return total


def posterior(m: Model, forms: Iterable[bool], sources: Iterable[str]) -> float:
    """Probability that a claim of this form, made by these sources, is whole."""
    k = tuple(map(bool, forms))
    # placeholders are few, so that sources agree on one by chance
    x = vote_of(sources, m.accuracy, m.dependence, 1.0 if k[0] else FALSE_VALUES) + math.log(m.whole[k] / m.false[k])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _sums(m: Model):
    """Sufficient statistics of a batch of counted patterns under the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[tuple[str, str, str], float] = defaultdict(float)
            for *forms, s, n in zip(*(b[f] for f in FORMS), b["s"], b["n"]):
                p = posterior(m, forms, s)
                shown = "".join("01"[bool(f)] for f in forms)
                out["whole", shown, ""] += n * p
                out["false", shown, ""] += n * (1 - p)
                for x in s:
                    out["source", x, ""] += n
                    out["right", x, ""] += n * p
                    if not forms[0]:
                        for y in s:
                            out["wrong", x, y] += n * (1 - p)
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["what", "x", "y", "w"])

    return run


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of ``patterns(short, open, doubled, continued, s, n)``: accuracies, dependence, shares of forms and
    posteriors are re-estimated together in each round.  What comes to the driver are sums by source and by pair of
    sources that share a claim."""
    m = START
    for _ in range(rounds):
        sums = patterns.mapInPandas(_sums(m), "what string, x string, y string, w double").groupBy("what", "x", "y").agg(F.sum("w").alias("w")).collect()
        w = {(r["what"], r["x"], r["y"]): r["w"] for r in sums}
        shares = []
        for kind in ("whole", "false"):
            n = {k: w.get((kind, "".join("01"[f] for f in k), ""), 0.0) for k in SHOWN}
            shares.append({k: max(RARE, v / (sum(n.values()) or 1.0)) for k, v in n.items()})
        shares[0] = {k: v if k == PLAIN else RARE for k, v in shares[0].items()}  # else copied errors would pass for whole
        dependence = {}
        for (what, x, y), n in w.items():
            if what == "wrong" and x != y:
                shared = n / w["wrong", x, x] if w["wrong", x, x] > 0 else 0.0
                d = (shared - 1 / FALSE_VALUES) / (1 - 1 / FALSE_VALUES)
                if d > 0:
                    dependence[x, y] = min(1.0, d)
        m = Model(
            *shares,
            {x: min(0.95, max(0.05, w["right", x, ""] / n)) for (what, x, _), n in w.items() if what == "source"},
            dependence,
        )
    return m


def posteriors(m: Model):
    """Column of the posterior of claims with ``FORMS`` and ``s``."""

    def run(short: pd.Series, open_: pd.Series, doubled: pd.Series, continued: pd.Series, s: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for *forms, sources in zip(short, open_, doubled, continued, s):
            k = (*forms, *sources)
            if k not in known:
                known[k] = posterior(m, forms, sources)
            out.append(known[k])
        return pd.Series(out, dtype=float)

    return F.when(F.col("v").isNotNull(), F.pandas_udf(run, "double")(*FORMS, "s")).otherwise(0.0)


def fuse(claims: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """``claims`` (of ``by_claim``, with ``continued``) with the posterior ``p`` of each, and the model.  A null or blank
    definition claims nothing and has posterior 0."""
    patterns = cut(claims.where("v is not null").groupBy(*FORMS, "s").agg(F.count("*").alias("n")))
    m = fit(patterns, rounds)
    drop(patterns)
    return claims.withColumn("p", posteriors(m)), m


# ---- groups --------------------------------------------------------------------------------------------------------


def _records(definitions_raw: DataFrame, documents: DataFrame, extractors: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = definitions_raw.where(F.col("def_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("term").rlike(r"(?U)\S"))
    raw = prepare(raw.select("def_id", "doc_id", "term", "definition", "line_no", "variant", "extracted_at"))
    rank = extractors.groupBy("variant").agg(F.min("trust_rank").alias("trust"))
    late = F.struct(F.coalesce(F.col("extracted_at").cast("timestamp"), F.to_timestamp(F.lit("0001-01-01"))).alias("at"), F.col("def_id"))
    rec = raw.join(maybe_broadcast(rank), "variant", "left").select("doc_id", "def_id", "term", "v", "short", "open", "doubled", "heads", "src", "trust", "line_no", late.alias("late"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rec, documents.select(F.col("doc_id").cast("string").alias("doc_id"), lines.alias("lines")).groupBy("doc_id").agg(F.max("lines").alias("lines"))


def _line_ok():
    return F.coalesce((F.col("line_no") >= 0) & (F.col("line_no") < F.col("lines")), F.lit(False))


def group_claims(definitions_raw: DataFrame, documents: DataFrame, extractors: DataFrame, gather: int = GATHER) -> DataFrame:
    """Claims of all groups, aggregated (``by_claim``), with ``continued``."""
    rec, lines = _records(definitions_raw, documents, extractors)
    keys = definitions_raw.where("doc_id is not null").select("doc_id")
    large = cut(large_documents(keys, gather))
    some = not large.isEmpty()
    if some:
        large = maybe_broadcast(large)
    small = rec.join(large, "doc_id", "left_anti") if some else rec
    # one shuffle by document, which every later step of this branch keeps
    cols = [c for c in rec.columns if c != "doc_id"]
    docs = small.groupBy("doc_id").agg(F.collect_set(F.struct(*cols)).alias("r"))
    docs = docs.select("doc_id", F.explode(F.arrays_zip("r", linked_arrays(F.col("r.term")).alias("e"))).alias("x")).select("doc_id", "x.r.*", F.col("x.e").alias("entity"))
    docs = docs.where("entity is not null").join(lines, "doc_id", "left").withColumn("line_ok", _line_ok())
    out = continued_gathered(by_claim(docs)).drop("heads")
    if some:
        big = rec.join(large, "doc_id", "left_semi").dropDuplicates(["doc_id", "def_id"])
        big = cut(big.join(lines, "doc_id", "left").withColumn("line_ok", _line_ok()))
        ent = link_names(big.select("doc_id", F.col("term").alias("name")), gather=gather).where("entity is not null").withColumnRenamed("name", "term")
        out = out.unionByName(continued_tables(cut(by_claim(big.join(ent, ["doc_id", "term"])))).select(out.columns))
    return out


def chosen(definitions_raw: DataFrame, documents: DataFrame, extractors: DataFrame, gather: int = GATHER) -> DataFrame:
    """The records that supply the fields of each group of two or more records of one document that define one term.

    Columns ``doc_id, entity, records, first_def_id, term_def_id, definition_def_id, posterior, line_def_id``.  The term
    comes from the most trusted source, the latest record breaking ties; the definition from the latest record that
    makes a claim of posterior ``WHOLE`` or more (-1 and null where none does); the line from the latest record whose
    ``line_no`` exists in the document (-1 if none).  Latest is by ``extracted_at`` with nulls first, then ``def_id``.
    Repeated rows count once; null or blank terms belong to no group; unknown sources are the least trusted; documents
    that are missing have no lines; other columns are ignored.  ``gather`` only says which of two equal ways a document
    takes.
    """
    claims = cut(group_claims(definitions_raw, documents, extractors, gather))
    post, _ = fuse(claims)
    best = post.groupBy("doc_id", "entity").agg(
        F.sum("n").alias("records"), F.min("lo").alias("first_def_id"), F.max("hi").alias("hi"), F.max("t").alias("t"),
        F.max(F.when(F.col("p") >= WHOLE, F.struct("late", "p"))).alias("d"), F.max("line").alias("line"),
    )
    return best.where("hi > first_def_id").select(
        "doc_id", "entity", "records", "first_def_id", F.col("t.l.def_id").alias("term_def_id"), F.coalesce("d.late.def_id", F.lit(-1)).alias("definition_def_id"),
        F.col("d.p").alias("posterior"), F.coalesce("line.def_id", F.lit(-1)).alias("line_def_id"),
    )


def representatives(definitions_raw: DataFrame, documents: DataFrame, extractors: DataFrame, gather: int = GATHER) -> DataFrame:
    """``chosen`` with the values themselves: ``term``, ``definition`` and ``line_no`` of the records chosen."""
    best = cut(chosen(definitions_raw, documents, extractors, gather))
    raw = definitions_raw.dropDuplicates(["def_id"])
    for field in ("term", "definition", "line_no"):
        key = f"{field.removesuffix('_no')}_def_id"
        best = best.join(raw.select(F.col("def_id").alias(key), field), key, "left")
    return best

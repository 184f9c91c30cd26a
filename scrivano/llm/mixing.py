"""Mixing sources to target shares: iterative proportional fitting and calibrated sampling.

Documents are counted in tokens of a public tokenizer and summed into cells of source, language and topic.  Raking
fits a weight to every cell so that the weighted tokens meet the source targets and the language and topic marginals
of the corpus, no weight above the source's ``max_repeats``.  The total is the largest at which every source that is
present can reach its share.  A document then gets floor(weight) copies and one more by systematic sampling inside hash
buckets of its cell, by calibrated probability; the last rounding error of a source stays below one document a bucket.

Topics come from the corpus: every document is tokenized once and its counts (hashed to ``WIDTH`` buckets) are written;
all of them are clustered (``scrivano.llm.topics``), and every document gets the topic nearest to all of its tokens.
Languages below ``LEAST_LANGUAGE`` of the tokens are raked together, so that cells are bounded by the listed sources times
1 / ``LEAST_LANGUAGE`` times ``TOPICS``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.topics import TOPICS, WIDTH, Topics, blocks, counts_batch, learn, row_bytes  # noqa: F401
from scrivano.session import cut, maybe_broadcast

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKET_ROWS, ROUNDS = 2_000, 60
LEAST_LANGUAGE, REST = 0.001, "other"


def normal_source(c):
    """Sources written unevenly: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def normal_lang(c):
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})", 1), F.lit("")), F.lit("und"))


@lru_cache(maxsize=2)
def _encoder(folder: str, vocabulary: str):
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """Column function of a text: its ``tokens``, and ``b`` and ``n`` of its row."""

    def run(text: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _encoder(folder, vocabulary)
        for s in text:
            ids = [np.asarray(enc.encode_ordinary(t) if t else [], np.int64) for t in s]
            rows = [row_bytes(x) for x in ids]
            yield pd.DataFrame({"tokens": np.array([len(x) for x in ids], np.int64), "b": [b for b, _ in rows], "n": [n for _, n in rows]})

    run.__annotations__ = {"text": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "tokens long, b binary, n binary")


def told(topics: Topics):
    """Column function of a row's ``b`` and ``n``: its topic."""

    def run(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for b, n in rows:
            yield pa.array(np.concatenate([np.zeros(0, np.int32), *(topics.of_rows(x) for x in blocks(counts_batch(b, n)))]), pa.int32())

    run.__annotations__ = {"rows": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "int")


def learn_topics(rows: DataFrame) -> Topics:
    """Topics of all documents of ``counted_rows`` that aren't blank."""
    return learn(rows.where("worded"))


def rake(cells: pd.DataFrame, shares: dict[str, float], caps: dict[str, int], rounds: int = ROUNDS) -> tuple[pd.DataFrame, float]:
    """Weights of ``cells(source, lang, topic, tokens)``; returns them with ``weight``, and the total of the mix."""
    c = cells[cells["source"].isin(shares) & (cells["tokens"] > 0)].reset_index(drop=True).copy()
    have = c.groupby("source")["tokens"].sum()
    open_ = {s: shares[s] for s in have.index if shares[s] > 0 and caps[s] > 0}
    c = c[c["source"].isin(open_)].reset_index(drop=True)
    if not len(c):
        return c.assign(weight=[]), 0.0
    scale = sum(open_.values())
    target = {s: v / scale for s, v in open_.items()}
    total = min(float(have[s]) * caps[s] / v for s, v in target.items())
    tok, cap = c["tokens"].to_numpy(float), c["source"].map(caps).to_numpy(float)
    w = np.minimum(c["source"].map(lambda s: target[s] * total / have[s]).to_numpy(float), cap)
    margins = [(c[k], c.groupby(k)["tokens"].sum() / tok.sum() * total) for k in ("lang", "topic")]
    source = (c["source"], pd.Series({s: v * total for s, v in target.items()}))
    for _ in range(rounds):
        for key, want in margins:
            now = pd.Series(w * tok).groupby(key).sum()
            w = np.minimum(w * key.map(want / now).to_numpy(float), cap)
        w = _to_source(w, tok, cap, *source)
    return c.assign(weight=w), total


def _to_source(w, tok, cap, key, want):
    """Scale each source to its target exactly; what a cap holds back goes to the source's other cells."""
    w = w.copy()
    for s, t in want.items():
        m = (key == s).to_numpy()
        for _ in range(50):
            now = float((w[m] * tok[m]).sum())
            if abs(now - t) <= 1e-9 * t or now == 0:
                break
            free = m & (w < cap)
            if now > t:
                w[m] *= t / now
            elif free.any():
                room = float((w[free] * tok[free]).sum())
                w[free] = np.minimum(w[free] * (1 + (t - now) / room), cap[free])
            else:
                break
    return w


def counted_rows(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    worded = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    return documents.select("doc_id", normal_source(F.col("source")).alias("source"), normal_lang(F.col("lang")).alias("lang"), worded.alias("worded"), counted(folder, vocabulary)("text").alias("c")).select(
        "doc_id", "source", "lang", "worded", "c.tokens", "c.b", "c.n"
    )


def sized(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """A cut of every document with its topic and tokens; the rows it is told from are removed."""
    rows = cut(counted_rows(documents, folder, vocabulary))
    return cut(rows.select("doc_id", "source", "lang", told(learn_topics(rows))("b", "n").alias("topic"), "tokens"), rows)


def mix(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: one row per document with ``doc_id, source, lang, topic, tokens, weight, copies`` (copies may be 0).
    Report: one row per target source (``kind`` 'source'), language and topic with ``kind, name, target_share,
    max_repeats, documents, tokens, used_documents, mixed_tokens, reached_share``; the targets of languages and topics
    are their shares of the tokens of listed sources.  Sources are compared normalised; documents of no listed source,
    of null source or without tokens get weight 0 and stay in the mix with no copies; a listed source without documents
    is reported with share 0 and its target is spread over the others.  Repeated targets count once; shares need not
    add to 1.  The report is one row per name and bounded as the cells are.
    """
    spark = documents.sparkSession
    docs = sized(documents, folder, vocabulary)
    t = targets.where("source is not null").select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = t.toPandas()
    listed = docs.join(maybe_broadcast(t.select("source")), "source", "left_semi")
    langs = listed.groupBy("lang").agg(F.sum("tokens").alias("n"))
    total = langs.agg(F.sum("n")).first()[0] or 0
    usual = [r["lang"] for r in langs.where(F.col("n") >= LEAST_LANGUAGE * total).collect()]
    raked = F.when(F.col("lang").isin(usual), F.col("lang")).otherwise(REST)
    local = listed.groupBy("source", raked.alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).toPandas()
    shares = {s: float(v or 0) for s, v in zip(goal["source"], goal["target_share"])}
    caps = {s: int(v or 0) for s, v in zip(goal["source"], goal["max_repeats"])}
    weights, _ = rake(local, shares, caps)
    w = weights.merge(local[["source", "lang", "topic", "n"]], how="left") if len(weights) else weights
    rows = [(r.source, r.lang, int(r.topic), float(r.weight), max(1, int(r.n) // BUCKET_ROWS)) for r in w.itertuples()]
    wdf = spark.createDataFrame(rows, "source string, raked string, topic int, weight double, buckets int")
    d = docs.withColumn("raked", raked).join(maybe_broadcast(wdf), ["source", "raked", "topic"], "left")
    unit = lambda *c: (F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    d = d.withColumn("weight", F.when(F.col("tokens") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.coalesce("buckets", F.lit(1))))
    # systematic sampling in order of size: the fractions run on from document to document
    part = (d["weight"] - F.floor(d["weight"])).alias("part")
    d = d.withColumn("part", part)
    picked = d.where("part > 0")
    cell = ("source", "raked", "topic", "bucket")
    run = F.sum("part").over(Window.partitionBy(*cell).orderBy("tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("run", run + unit(*cell)).withColumn("extra", (F.floor("run") - F.floor(F.col("run") - F.col("part"))).cast("int")).drop("run")
    out = picked.unionByName(d.where("part = 0").withColumn("extra", F.lit(0)))
    out = cut(out.select("doc_id", "source", "lang", "topic", "tokens", F.col("weight"), (F.floor("weight").cast("int") + F.least(F.col("extra"), F.lit(1))).alias("copies")), docs)
    return out, _report(out, t)


def _report(out: DataFrame, t: DataFrame) -> DataFrame:
    mine = out.join(maybe_broadcast(t.select("source")), "source", "left_semi")
    kind = F.when(F.col("g") == 0, "source").when(F.col("g") == 1, "language").otherwise("topic")
    names = mine.select("tokens", "copies", F.posexplode(F.array("source", "lang", F.col("topic").cast("string"))).alias("g", "name"))
    sums = names.groupBy(kind.alias("kind"), "name").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.count_if(F.col("copies") > 0).alias("used_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens")
    )
    goals = t.select(F.lit("source").alias("kind"), F.col("source").alias("name"), "target_share", "max_repeats")
    rows = sums.join(maybe_broadcast(goals), ["kind", "name"], "full").fillna(0, ["documents", "tokens", "used_documents", "mixed_tokens"])
    all_ = Window.partitionBy("kind")  # a few rows a kind
    over = lambda c: F.when(F.sum(c).over(all_) > 0, F.col(c) / F.sum(c).over(all_)).otherwise(0.0)
    return rows.select(
        "kind", "name", F.when(F.col("kind") == "source", F.col("target_share")).otherwise(over("tokens")).alias("target_share"), "max_repeats",
        "documents", "tokens", "used_documents", "mixed_tokens", over("mixed_tokens").alias("reached_share"),
    )

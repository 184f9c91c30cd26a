"""Evaluation passages inside a training corpus: prefix-filtered set join and exact verification.

The held-out items are the query set; they are taken in blocks of bounded size against all documents.  Items are cut
into windows of ``WINDOW`` words, windows into 5-word shingles.  A passage of a window with at most ``EDITS`` words
changed keeps at least ``NEED`` of its shingles, so with shingles ordered by rarity in the corpus one of the window's
``len - NEED + 1`` rarest must occur in the document.  Documents are read once to emit the shingles that any item has;
their document counts give the order; pairs that share a prefix shingle are bounded by length and position (at least
``NEED`` shingles of one window within a span of the document that the edits allow); what is left is aligned word by
word and kept if a stretch of at least ``WINDOW`` item words has at most ``RATE`` edits a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.llm.tokens import WORDS, batch_words, fold_text, shingle_hashes
from scrivano.session import cut, maybe_broadcast

N, WINDOW, EDITS, RATE, SLACK, BLOCK = 5, 20, 2, 0.12, 4, 5_000
INDEX_ROWS = 1_000_000  # up to which a block's shingles (three numbers each, about 24 MB) may be broadcast
NEED = WINDOW - N + 1 - EDITS * N


def item_shingles(items: pd.DataFrame) -> pd.DataFrame:
    """``item_id, pos, h`` of a block of items."""
    words, off = batch_words(items["text"].tolist(), WORDS, fold_text)
    out = []
    for k, i in enumerate(items["item_id"]):
        w = words[off[k] : off[k + 1]]
        h = shingle_hashes(w, N).view(np.int64)
        out.append(pd.DataFrame({"item_id": np.full(len(h), i, np.int64), "pos": np.arange(len(h), dtype=np.int32), "h": h, "words": np.int32(len(w))}))
    return pd.concat(out) if out else pd.DataFrame({"item_id": [], "pos": [], "h": [], "words": []})


def _hits(known: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, off = batch_words(b["text"].tolist(), WORDS, fold_text)
            doc = np.repeat(np.arange(len(b)), np.diff(off))
            h = shingle_hashes(words, N).view(np.int64)
            at = np.searchsorted(known, h)
            ok = (known[np.minimum(at, len(known) - 1)] == h) & (doc[: len(h)] == doc[N - 1 :]) if len(h) else np.zeros(0, bool)
            i = np.flatnonzero(ok)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[doc[i]], "dpos": (i - off[doc[i]]).astype(np.int32), "h": h[i]})

    return run


def align(doc: np.ndarray, item: np.ndarray, least: int = WINDOW, rate: float = RATE) -> bool:
    """Does a stretch of ``item`` of at least ``least`` words stand in ``doc`` with at most ``rate`` edits a word?

    For every number of edits the furthest-reaching alignment on each diagonal is extended from each start, which
    finds the longest stretch for that number of edits exactly.  A start is given up only where it can't be the first
    word of a shortest such stretch: what follows its first ``e`` edits would either be one itself or have less than
    ``least`` words, so ``e`` edits must have reached a span of ``e / rate - least``.
    """
    n, m = len(item), len(doc)
    if n < least or m < least - least * rate:
        return False
    most = int(rate * n)
    same = {}
    for j, w in enumerate(doc.tolist()):
        same.setdefault(w, []).append(j)
    starts = [(i, j) for i, w in enumerate(item.tolist()) for j in same.get(w, ()) if i == 0 or j == 0 or item[i - 1] != doc[j - 1]]
    it, dt = item.tolist(), doc.tolist()
    for i0, j0 in starts:
        if i0 + least > n:
            continue
        reach = {j0 - i0: i0}
        for e in range(most + 1):
            ext = {}
            for d, i in reach.items():
                while i < n and 0 <= i + d < m and it[i] == dt[i + d]:
                    i += 1
                ext[d] = i
            span = max((i for d, i in ext.items() if i > reach[d]), default=i0) - i0  # the last word is in place
            if span >= least and e <= rate * span:
                return True
            if e + 1 > rate * (n - i0) or e > rate * (max(ext.values()) - i0 + least):
                break
            reach = {}
            for d, i in ext.items():
                for dd, ii in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):
                    if ii <= n and 0 <= ii + dd <= m and reach.get(dd, -1) < ii:
                        reach[dd] = ii
            if not reach:
                break
    return False


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        dw, do = batch_words(b["text"].tolist(), WORDS, fold_text)
        iw, io = batch_words(b["item_text"].tolist(), WORDS, fold_text)
        ok = []
        for k, (lo, hi) in enumerate(zip(b["lo"], b["hi"])):
            w = dw[do[k] : do[k + 1]]
            item = iw[io[k] : io[k + 1]]
            ok.append(align(w[max(0, lo - len(item)) : hi + N + len(item)], item))
        b = b[np.array(ok, bool)]
        yield b[["doc_id", "item_id"]]


def leaked(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct ``(doc_id, item_id)``: the document holds at least ``WINDOW`` words of the item in sequence, with few
    edits.  Null or blank texts and items shorter than the window match nothing; copies of a document count each;
    repeated rows count once; other columns are ignored.
    """
    spark = documents.sparkSession
    rows = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    buckets = max(1, -(-rows.count() // block))
    found = None
    for k in range(buckets):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(buckets)) == k)
        one = _block(spark, documents.select("doc_id", "text").where("text is not null"), part)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _block(spark, docs: DataFrame, items: DataFrame) -> DataFrame:
    mine = items.toPandas()  # at most about BLOCK items
    sh = item_shingles(mine)
    sh = sh[sh["words"] >= WINDOW]
    if not len(sh):
        return spark.createDataFrame([], "doc_id long, item_id long")
    known = np.unique(sh["h"].to_numpy(np.int64))
    hits = cut(docs.mapInPandas(_hits(known), "doc_id long, dpos int, h long"))
    df = hits.groupBy("h").agg(F.count_distinct("doc_id").alias("df"))
    idx = spark.createDataFrame(sh[["item_id", "pos", "h"]].astype({"item_id": "int64", "pos": "int32", "h": "int64"}))
    idx = idx.join(maybe_broadcast(df), "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    size = WINDOW - N + 1
    last = idx.groupBy("item_id").agg(F.max("pos").alias("last"))
    wins = idx.join(last, "item_id").withColumn("win", F.explode(F.sequence(F.greatest(F.col("pos") - size + 1, F.lit(0)), F.least("pos", F.col("last") - size + 1))))
    rank = F.row_number().over(Window.partitionBy("item_id", "win").orderBy("df", "h", "pos"))
    prefix = cut(wins.withColumn("rank", rank).where(F.col("rank") <= size - NEED + 1).select("item_id", "pos", "h").distinct())
    pairs = hits.join(maybe_broadcast(prefix.select("h", "item_id").distinct(), INDEX_ROWS), "h").select("doc_id", "item_id").distinct()
    # positional bound: NEED distinct shingles of one window, near one diagonal
    shared = hits.join(maybe_broadcast(idx.select("h", "item_id", "pos"), INDEX_ROWS), "h").join(pairs, ["doc_id", "item_id"])
    diag = F.floor((F.col("dpos") - F.col("pos")) / SLACK)
    near = shared.withColumn("diag", F.explode(F.array(diag, diag + 1))).groupBy("doc_id", "item_id", "diag").agg(
        F.sort_array(F.collect_set("pos")).alias("ps"), F.min("dpos").alias("lo"), F.max("dpos").alias("hi")
    )
    dense = F.exists(F.sequence(F.lit(0), F.size("ps") - NEED), lambda i: F.get("ps", i + NEED - 1) - F.get("ps", i) < size)
    near = near.where(F.size("ps") >= NEED).where(dense).groupBy("doc_id", "item_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cand = cut(near)
    texts = docs.join(maybe_broadcast(cand.select("doc_id").distinct()), "doc_id", "left_semi")
    full = maybe_broadcast(cand).join(texts, "doc_id").join(maybe_broadcast(items.withColumnRenamed("text", "item_text")), "item_id")
    return full.select("doc_id", "item_id", "lo", "hi", "text", "item_text").mapInPandas(_verify, "doc_id long, item_id long")

"""Repetition inside single documents.

Every document is read once and its word 5-grams are hashed.  The events of a document are its words: a word is
*recurrent* if it lies in a hashed 5-gram that the document stated before, or in a loop of a shorter phrase run through
at least three times, else *first*.  Two multinomials over the events are counted over all documents: the raw corpus,
and the target, from documents trusted for a reason other than repetition (``trusted``, such as a complete provenance),
with as many first words again as a prior, since a text worth keeping states things once.  The length-normalised
log-likelihood ratio of a document between the two then decides: a document is kept or flagged by one threshold, the
ratio of a document of which the share ``SHARE`` of the words is recurrent.  TESTDATA.md defines the required rows by
that share, so the ratio has to rank documents as the share does; the share itself is reported beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.llm.tokens import LETTERS, batch_words, shingle_hashes
from scrivano.session import cut

N, SHARE = 5, 0.4


def recurrent_words(words: np.ndarray, offsets: np.ndarray, n: int = N) -> np.ndarray:
    """Which words of a batch are recurrent."""
    total = len(words)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hit = np.zeros(total + 1, np.int64)
    h = shingle_hashes(words, n)
    before = np.full(len(h), -1, np.int64)
    if len(h):
        inside = doc[: len(h)] == doc[n - 1 :]
        pos = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            key = (h[pos] ^ (doc[pos].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
        before[pos[order]] = np.arange(len(k)) - first
        again = np.flatnonzero(before > 0)
        np.add.at(hit, again, 1)
        np.add.at(hit, again + n, -1)
    marked = np.cumsum(hit)[:total] > 0
    for p in range(1, n):  # loops of p words
        same = np.zeros(total, bool)
        if total > p:
            same[p:] = (words[p:] == words[:-p]) & (doc[p:] == doc[:-p])
        edge = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= max(2 * p, 3):
                marked[a:b] = True
    return marked


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        words, off = batch_words(b["text"].tolist(), LETTERS)
        docs = len(b)
        doc = np.repeat(np.arange(docs), np.diff(off))
        again = np.bincount(doc[recurrent_words(words, off)], minlength=docs) if len(words) else np.zeros(docs, np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"], "trusted": b["trusted"], "words": np.diff(off), "repeated": again})


def weights(raw: tuple[int, int], target: tuple[int, int]) -> tuple[float, float]:
    """Log ratios target : raw of a recurrent and a first word, from the (recurrent, all) words of each."""
    (r, n), (t, m) = raw, target
    p, q = (t + 0.5) / (2 * m + 1), (r + 0.5) / (n + 1)
    return math.log(p / q), math.log((1 - p) / (1 - q))


def repetition(documents: DataFrame, trusted: Column | None = None, share: float = SHARE) -> DataFrame:
    """One row per document: ``doc_id, words, repeated, share, llr, flagged``.

    Case, punctuation and digits do not count; a null or blank text has no words, share 0, a null ``llr`` and is not
    flagged; documents shorter than five words can only loop.  ``trusted`` (a condition on the documents, null counting
    as false) defaults to all of them.  ``flagged`` is decided by the ratio alone, ties counting as flagged; where the
    trusted documents are so repetitive that recurrence speaks for them, the ratio is read the other way round.
    Repeated rows of one id are measured each; other columns are ignored.
    """
    told = F.coalesce(trusted, F.lit(False)) if trusted is not None else F.lit(True)
    m = cut(documents.select("doc_id", "text", told.alias("trusted")).mapInPandas(_measure, "doc_id long, trusted boolean, words long, repeated long"))
    t = m.agg(*[F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).alias(f"{k}{x}") for k, c in (("raw", F.lit(True)), ("good", F.col("trusted"))) for x in ("repeated", "words")]).first()
    again, first = weights((t["rawrepeated"], t["rawwords"]), (t["goodrepeated"], t["goodwords"]))
    llr = F.when(F.col("words") > 0, (F.col("repeated") * F.lit(again) + (F.col("words") - F.col("repeated")) * F.lit(first)) / F.col("words"))
    threshold, slack = share * again + (1 - share) * first, 1e-9 * abs(again - first)
    below = F.col("llr") <= threshold + slack if again <= first else F.col("llr") >= threshold - slack
    return m.select("doc_id", "words", "repeated", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(0.0).alias("share"), llr.alias("llr")).withColumn("flagged", F.coalesce(below, F.lit(False)))

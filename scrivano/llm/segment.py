"""Oversized texts and id lists cut at natural boundaries.

Texts: natural boundaries are sentence ends, ';' or ':' before white space, blank lines and starts of list items.
Lexical cohesion is measured at each of them as the cosine between the word-stem counts (hashed to a fixed width) of a
block of words before and after; its valleys mark topic changes.  Within the window in which a piece may end, the
boundary of the deepest valley is chosen; where no boundary lies in reach, the piece is cut at a blank, else at the
limit.  Every further piece begins ``overlap`` characters before the end of the one before, so pieces are substrings,
never exceed the limit and give the text back.  Id lists are cut the same way, the change of kind being the boundary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, TEXT_OVERLAP, ID_LIMIT, ID_OVERLAP = 1200, 100, 12, 1
BLOCK, WIDTH, STEM = 40, 64, 5

BOUNDARY = re.compile(r"[.!?…]+[\"”»')\]]*(?=\s)|[;:](?=\s)|\n[^\S\n]*(?=\n)|\n(?=[^\S\n]*(?:[-–—•*·▪]|\d{1,3}[.)]|[A-Za-z]\))\s)")
WORD = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word[:STEM].encode()) % WIDTH


def boundaries(text: str) -> list[int]:
    """Positions at which a piece may end naturally, ascending, inside the text."""
    return [p for p in dict.fromkeys(m.end() for m in BOUNDARY.finditer(text)) if 0 < p < len(text)]


def natural(stretches: list[int], limit: int) -> bool:
    return all(s <= limit for s in stretches)


def depths(text: str, cuts: list[int]) -> np.ndarray:
    """Depth of the cohesion valley at each boundary: how far the similarity climbs from it to the nearest peak on either
    side (0 where neither side rises)."""
    starts, ids = [], []
    for m in WORD.finditer(text.lower()):
        starts.append(m.start())
        ids.append(_bucket(m[0]))
    n = len(ids)
    if n < 2 or not cuts:
        return np.zeros(len(cuts))
    sums = np.zeros((n + 1, WIDTH), np.float32)
    sums[np.arange(1, n + 1), ids] = 1
    np.cumsum(sums, axis=0, out=sums)
    at = np.searchsorted(np.asarray(starts), np.asarray(cuts))
    left, right = sums[at] - sums[np.maximum(at - BLOCK, 0)], sums[np.minimum(at + BLOCK, n)] - sums[at]
    norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    sim = (left * right).sum(1) / np.where(norm > 0, norm, 1)
    return (climb(sim) - sim) + (climb(sim[::-1])[::-1] - sim)


def climb(sim: np.ndarray) -> np.ndarray:
    """Similarity at the nearest peak to the left, going up only."""
    out = sim.copy()
    for k in range(1, len(sim)):
        if sim[k - 1] >= sim[k]:
            out[k] = out[k - 1]
    return out


def cut_points(size: int, cuts: list[int], depth, limit: int, overlap: int, spare=None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of something ``size`` long.  ``spare`` gives an end where no boundary is in reach."""
    out, start = [], 0
    while size - start > limit:
        low, high = start + max(overlap + 1, limit // 2), start + limit
        window = [k for k, p in enumerate(cuts) if low <= p <= high]
        if not window:
            window = [k for k, p in enumerate(cuts) if start + overlap < p <= high][-1:]
        if window:
            end = cuts[max(window, key=lambda k: (round(float(depth[k]), 6), cuts[k]))]
        else:
            end = spare(start + overlap + 1, high) if spare else high
        out.append((start, end))
        start = end - overlap
    out.append((start, size))
    return out


def split_text(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> tuple[list[tuple[int, int]], bool]:
    cuts = boundaries(text)
    edges = [0, *cuts, len(text)]
    whole = natural([len(text[a:b].strip()) for a, b in zip(edges, edges[1:])], limit)

    def spare(low: int, high: int) -> int:
        at = max(text.rfind(" ", low, high), text.rfind("\n", low, high))
        return at + 1 if at >= low else high

    return cut_points(len(text), cuts, depths(text, cuts), limit, overlap, spare), whole


def kind_of(evidence_id: str | None) -> str:
    m = re.search(r"_(definition|passage)_", evidence_id or "")
    return m[1] if m else ""


def changes(ids: list) -> list[int]:
    kinds = [kind_of(x) for x in ids]
    return [i for i in range(1, len(ids)) if kinds[i] != kinds[i - 1]]


def split_ids(ids: list, limit: int = ID_LIMIT, overlap: int = ID_OVERLAP) -> tuple[list[tuple[int, int]], bool]:
    cuts = changes(ids)
    edges = [0, *cuts, len(ids)]
    # a change between longer runs is the deeper valley
    runs = [b - a for a, b in zip(edges, edges[1:])]
    depth = [runs[k] + runs[k + 1] for k in range(len(cuts))]
    return cut_points(len(ids), cuts, depth, limit, overlap), natural(runs, limit)


PIECES = "src string, item_key string, piece int, pieces int, start int, end int, text string, ids array<string>, cut string, ends string"


def _pieces(text_limit: int, text_overlap: int, id_limit: int, id_overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for src, key, text, ids in zip(b["src"], b["item_key"], b["text"], b["ids"]):
                isText = src == "text"
                val = text if isText else list(ids)
                spans, whole = split_text(val, text_limit, text_overlap) if isText else split_ids(val, id_limit, id_overlap)
                ends = {len(val), *(boundaries(val) if isText else changes(val))}
                for k, (s, e) in enumerate(spans):
                    rows.append((src, key, k, len(spans), s, e, val[s:e] if isText else None, None if isText else val[s:e], "natural" if whole else "forced", "natural" if e in ends else "forced"))
            yield pd.DataFrame(rows, columns=["src", "item_key", "piece", "pieces", "start", "end", "text", "ids", "cut", "ends"])

    return run


def oversized(items: DataFrame, text_limit: int = TEXT_LIMIT, id_limit: int = ID_LIMIT) -> DataFrame:
    return items.where(((F.col("src") == "text") & (F.length("text") > text_limit)) | ((F.col("src") == "evidence") & (F.size("ids") > id_limit)))


def split_oversized(items: DataFrame, text_limit: int = TEXT_LIMIT, text_overlap: int = TEXT_OVERLAP, id_limit: int = ID_LIMIT, id_overlap: int = ID_OVERLAP) -> DataFrame:
    """Pieces of the items over their limit, row by row: ``items(src, item_key, text, ids)``, src 'text' or 'evidence'.

    Items within the limit, null texts and null lists give no rows.  ``start`` and ``end`` count from 0 in code points
    or ids; ``cut`` is 'natural' if every stretch between neighbouring boundaries (outer white space apart) fits the
    limit, else 'forced'; ``ends`` says the same of the end of the piece itself, which may lie inside a stretch that
    fits the limit but not what the overlap leaves of it.  Repeated rows give repeated pieces; null ids count as ids.  No shuffle.
    """
    if text_overlap * 2 >= text_limit or id_overlap * 2 >= id_limit:
        raise ValueError("the overlap must be less than half of the limit")
    return oversized(items, text_limit, id_limit).select("src", "item_key", "text", "ids").mapInPandas(_pieces(text_limit, text_overlap, id_limit, id_overlap), PIECES)


def procedure_items(diagram_procedures: DataFrame, procedure_records: DataFrame) -> DataFrame:
    no_ids, no_text = F.lit(None).cast("array<string>").alias("ids"), F.lit(None).cast("string").alias("text")
    a = diagram_procedures.select(F.lit("text").alias("src"), F.col("procedure_id").alias("item_key"), F.col("original_text_full").alias("text"), no_ids)
    b = procedure_records.select(F.lit("evidence").alias("src"), F.col("procedure_id").alias("item_key"), no_text, F.col("evidence_chunk_ids").alias("ids"))
    return a.unionByName(b)

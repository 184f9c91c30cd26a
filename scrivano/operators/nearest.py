"""Exact search over texts in Arrow batches: embedding, distances and ranks in one pass, no vector leaves the worker.

Distances are those of ``retrieval.squared_l2``: the same sums in the same order, rounded as Spark rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
CHARS, PAIRS, GATHERED, ITEMS = 200_000, 20_000, 1_000_000, 1_000


def matrix(texts: list, dims: int = 64) -> np.ndarray:
    """A row per text: character 3-grams of the lower-cased, padded text hashed to ``dims`` buckets, L2-normalised; zeros
    without a 3-gram."""
    padded = [f" {(t or '').lower()} " for t in texts]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    upto, out, at = np.cumsum(size), np.zeros((len(padded), dims)), 0
    while at < len(padded):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARS, "right")))
        c = np.frombuffer("".join(padded[at:end]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(end - at), size[at:end])
        with np.errstate(over="ignore"):
            h = ((c[:-2] * MIX + c[1:-1]) * MIX + c[2:]) * MIX
        bucket = ((h >> np.uint64(40)) % np.uint64(dims)).astype(np.int64)
        inside = row[:-2] == row[2:]
        out[at:end] = np.bincount((row[:-2] * dims + bucket)[inside], minlength=(end - at) * dims).reshape(-1, dims)
        at = end
    n = np.sqrt((out * out).sum(axis=1))
    return out / np.where(n > 0, n, 1.0)[:, None]


def rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, of the number as it is printed."""
    s = d * 10.0**digits
    r = np.floor(s + 0.5) / 10.0**digits
    for i in np.flatnonzero(np.abs(s - np.floor(s) - 0.5) < 1e-6):
        r[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return r


def distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, digits: int) -> np.ndarray:
    """Of the pairs of columns ``a[:, i]`` and ``b[:, j]``; the squares are added from the first dimension on."""
    out = np.empty(len(i))
    for s in range(0, len(i), PAIRS):
        d = np.take(a, i[s : s + PAIRS], axis=1) - np.take(b, j[s : s + PAIRS], axis=1)
        d *= d
        total = d[0]
        for x in d[1:]:
            total += x
        out[s : s + PAIRS] = total
    return rounded(out, digits)


def codes(a: pa.Array) -> np.ndarray:
    """Equal numbers for equal values, also of structs."""
    if pa.types.is_struct(a.type):
        parts = np.column_stack([codes(x) for x in a.flatten()])
        return np.unique(parts, axis=0, return_inverse=True)[1].reshape(-1)
    return a.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def order_of(a: pa.Array) -> np.ndarray:
    """Numbers that sort as the values do; texts by their bytes."""
    return pc.rank(a, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def places(group: np.ndarray) -> np.ndarray:
    """1, 2, ... within runs of equal numbers."""
    at = np.arange(len(group))
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0)) + 1


def runs(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` together, one row at least."""
    upto, at = np.cumsum(weight), 0
    while at < len(weight):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _parts(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Offsets and the fields of all structs of a column of lists."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return off - off[0], lists.flatten().flatten()


def within(k: int, digits: int):
    """Batches ``qs, its``, lists of ``(query_id, text)`` and ``(id, text)`` of one key, to ``query_id, rank, id,
    distance``."""

    def run(batches):
        for b in batches:
            (qo, (qid, qtext)), (io, (iid, itext)) = _parts(b.column(0)), _parts(b.column(1))
            pairs = np.diff(qo) * np.diff(io)
            for s, e in runs(pairs, GATHERED):
                q0, i0 = qo[s], io[s]
                ids, qids = iid.slice(i0, io[e] - i0), qid.slice(q0, qo[e] - q0)
                first = np.concatenate([[0], np.cumsum(pairs[s:e])])
                g = np.repeat(np.arange(e - s), pairs[s:e])
                local, n = np.arange(first[-1]) - first[g], np.diff(io)[s:e][g]
                q, i = qo[s:e][g] - q0 + local // np.maximum(n, 1), io[s:e][g] - i0 + local % np.maximum(n, 1)
                a = np.ascontiguousarray(matrix(qtext.slice(q0, len(qids)).to_pylist()).T)
                v = np.ascontiguousarray(matrix(itext.slice(i0, len(ids)).to_pylist()).T)
                d = distances(v, i, a, q, digits)
                who = codes(qids)[q] if len(q) else q
                order = np.lexsort((order_of(ids)[i] if len(i) else i, d, who, g))
                rank = places((g * (len(qids) + 1) + who)[order])
                kept = order[rank <= k]
                rank = rank[rank <= k].astype(np.int32)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[kept])), pa.array(rank), ids.take(pa.array(i[kept])), pa.array(d[kept])], names=["query_id", "rank", "id", "distance"])

    return run


def among(qids: pa.Array, qmat: np.ndarray, k: int, digits: int):
    """Batches ``id, text`` to the ``k`` nearest of a partition for each of the queries: ``query_id, id, distance``.

    A matrix product tells which pairs can be among the nearest, with room for its error and for rounding; these are
    measured exactly.
    """
    slack = 2 * 10.0**-digits

    def run(batches):
        qt, q2 = np.ascontiguousarray(qmat.T), (qmat * qmat).sum(axis=1)
        far = np.full(len(qmat), np.inf)
        best_q, best_d, best_id = np.empty(0, np.int64), np.empty(0), None
        for b in batches:
            for s in range(0, b.num_rows, ITEMS):
                ids, v = b.column(0).slice(s, ITEMS), matrix(b.column(1).slice(s, ITEMS).to_pylist())
                near = qmat @ v.T
                near *= -2.0
                near += q2[:, None]
                near += (v * v).sum(axis=1)[None, :]
                limit = far
                if len(ids) >= k and np.isinf(far).any():
                    limit = np.minimum(far, np.partition(near, k - 1, axis=1)[:, k - 1])
                q, i = np.nonzero(near <= (limit + slack)[:, None])
                if not len(q):
                    continue
                d = distances(np.ascontiguousarray(v.T), i, qt, q, digits)
                all_id = ids.take(pa.array(i)) if best_id is None else pa.concat_arrays([best_id, ids.take(pa.array(i))])
                all_q, all_d = np.concatenate([best_q, q]), np.concatenate([best_d, d])
                order = np.lexsort((order_of(all_id), all_d, all_q))
                rank = places(all_q[order])
                last = order[rank == k]
                far[all_q[last]] = all_d[last]
                kept = order[rank <= k]
                best_q, best_d, best_id = all_q[kept], all_d[kept], all_id.take(pa.array(kept))
        if best_id is not None:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(best_q)), best_id, pa.array(best_d)], names=["query_id", "id", "distance"])

    return run


def first_hits(queries: list[str], least: int, digits: int = 6):
    """Batches ``doc_id, ls, k, most``, with ``ls`` a list of ``(line_no, text)``, to the lines that are among the ``k``
    nearest of a query, in order of queries and ranks the first ``most`` of ``least`` characters: ``doc_id, line_no, text``."""
    asked = matrix(queries).T

    def run(batches):
        for b in batches:
            off, (number, text) = _parts(b.column(1))
            k, most = b.column(2).to_numpy(), b.column(3).to_numpy()
            for s, e in runs(np.diff(off), PAIRS):
                doc = np.repeat(np.arange(s, e), np.diff(off[s : e + 1]))
                at, texts = number.slice(off[s], len(doc)).to_numpy(), text.slice(off[s], len(doc)).to_pylist()
                v = np.ascontiguousarray(matrix(texts).T)
                every, none = np.arange(len(doc)), np.iinfo(np.int64).max
                first = np.full(len(doc), none)
                for no in range(asked.shape[1]):
                    d = distances(v, every, asked, np.full(len(doc), no), digits)
                    order = np.lexsort((at, d, doc))
                    rank = places(doc[order])
                    hit = rank <= k[doc[order]]
                    first[order[hit]] = np.minimum(first[order[hit]], (no << 40) + rank[hit])
                line = np.unique(np.column_stack([doc, at]), axis=0, return_inverse=True)[1].reshape(-1)
                low = np.full(len(doc), none)
                np.minimum.at(low, line, first)
                first = low[line]
                long = np.fromiter(map(len, texts), np.int64, len(texts)) >= least
                order = np.lexsort((at, first, doc))
                order = order[(first[order] < none) & long[order]]
                kept = order[places(doc[order]) <= most[doc[order]]]
                where = pa.array(kept + off[s])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[kept])), number.take(where), text.take(where)], names=["doc_id", "line_no", "text"])

    return run

"""Topics of a corpus: spherical k-means of token directions, fitted on every document.

A document is a sparse row: the token buckets it holds (``b``) and how often (``n``), weighted by inverse document
frequency and scaled to length 1.  A start from principal direction divisive partitioning (the cluster with most members
that differ is split where they project on either side of their mean) is followed by rounds of k-means.  Every step is a
sum over all rows: of whole numbers, as weights, axes and centres are held in units of 1 / ``UNIT``.  So the sums are
exact and the topics depend neither on how the rows are spread nor on whether Spark adds them up (``Spread``) or, for up
to ``HELD`` entries, the driver (``Held``).

Principal directions are taken among the ``AXES`` leading ones of the corpus, found by subspace iteration, so that a
split needs moments of ``AXES`` numbers a document; the rounds of k-means use all ``WIDTH`` buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.session import cut, drop

WIDTH, TOPICS, FITS = 2_048, 12, 8
AXES, TURNS = 24, 3
UNIT = 1 << 15
#: Entries of rows that the driver may hold; numbers it may get at once, else in sums by pieces; rows of a dense block.
HELD, GOT, PIECE, BLOCK = 4_000_000, 1_000_000, 4_096, 32


class Rows(NamedTuple):
    """A block of sparse rows run together: the place of each entry (its row times ``WIDTH``, and its bucket; 16 bits hold
    it), its count or weight, and the number of rows."""

    at: np.ndarray
    v: np.ndarray
    size: int

    def weighted(self, idf: np.ndarray) -> Rows:
        """The rows of counts at length 1, in units."""
        row, b = np.divmod(self.at, WIDTH)
        v = self.v * idf[b]
        length = np.sqrt(np.bincount(row, v * v, self.size))
        return self._replace(v=np.rint(v / np.maximum(length, 1e-9)[row] * UNIT))

    def dense(self) -> np.ndarray:
        x = np.zeros(self.size * WIDTH)
        x[self.at] = self.v
        return x.reshape(self.size, WIDTH)

    def times(self, m: np.ndarray) -> np.ndarray:
        """The weighted rows times a matrix in units; exact, in squared units."""
        return self.dense() @ m


def row_bytes(ids: np.ndarray) -> tuple[bytes, bytes]:
    """``b`` and ``n`` of token ids."""
    n = np.bincount(ids % WIDTH, minlength=WIDTH)
    b = n.nonzero()[0]
    return b.astype(np.uint16).tobytes(), n[b].astype(np.uint32).tobytes()


def _flat(c: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column without nulls, and where each value ends among them (from 0 on)."""
    ends = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)
    return data, (ends - ends[0]) // data.itemsize


def blocks(p: pa.RecordBatch) -> Iterator:
    """Blocks of rows of a batch: of rows with ``b`` and ``n`` (counts; 1 where they are left out), or of what ``_batch`` made."""
    if not p.num_rows:
        return
    if "z" in p.schema.names:
        yield _flat(p.column("z"), np.int32)[0].reshape(-1, AXES).astype(float)
    elif "q" in p.schema.names:
        for at, q, size in zip(*(p.column(k).to_pylist() for k in ("at", "q", "size"))):
            yield Rows(np.frombuffer(at, np.uint16), np.frombuffer(q, np.uint16), size)
    else:
        b, ends = _flat(p.column("b"), np.uint16)
        n = _flat(p.column("n"), np.uint32)[0] if "n" in p.schema.names else np.ones(len(b), np.uint32)
        at = np.repeat((np.arange(p.num_rows) % BLOCK * WIDTH).astype(np.uint16), np.diff(ends)) + b
        for k in range(0, p.num_rows, BLOCK):
            i, j = ends[k], ends[min(k + BLOCK, p.num_rows)]
            yield Rows(at[i:j], n[i:j], min(BLOCK, p.num_rows - k))


def counts_batch(b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(list(x), pa.binary()) for x in (b, n)], ["b", "n"])


def _batch(parts: list) -> pa.RecordBatch:
    """A row for every block of weighted rows, or of projections."""
    if not isinstance(parts[0], Rows):
        return pa.RecordBatch.from_arrays([pa.array([z.astype(np.int32).tobytes() for z in parts], pa.binary())], ["z"])
    at, q = ([x.astype(np.uint16).tobytes() for x in y] for y in zip(*((x.at, x.v) for x in parts)))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(q, pa.binary()), pa.array([x.size for x in parts], pa.int32())], ["at", "q", "size"])


def _sum(f: Callable, parts: Iterator, shape: tuple) -> np.ndarray:
    """Whole numbers, added as floats: those of a batch stay far below 2 ** 53."""
    total = np.zeros(shape)
    for p in parts:
        total += f(p)
    return total.astype(np.int64)


class Held(NamedTuple):
    """Rows on the driver."""

    parts: list

    def sum(self, f: Callable, shape: tuple) -> np.ndarray:
        return _sum(f, self.parts, shape)

    def only(self, *columns: str) -> Held:
        return self

    def map(self, f: Callable, schema: str) -> Held:
        return Held([f(p) for p in self.parts])

    def close(self) -> None:
        pass


class Spread(NamedTuple):
    """Rows of a table in ``tasks`` partitions."""

    table: DataFrame
    tasks: int

    @staticmethod
    def of(table: DataFrame) -> Spread:
        return Spread(table, table.rdd.getNumPartitions())

    def sum(self, f: Callable, shape: tuple) -> np.ndarray:
        """Sums of many tasks meet in pieces first, so that the driver gets one sum however many tasks there are."""
        size = int(np.prod(shape))

        def batch(sums: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["k", "s"])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((_sum(f, blocks(p), shape) for p in batches), np.zeros(shape, np.int64)).ravel()
            yield batch({k: total[k : k + PIECE] for k in range(0, size, PIECE)})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for p in batches:
                for k, s in zip(p.column("k").to_pylist(), p.column("s").to_pylist()):
                    sums[k] = sums.get(k, 0) + np.frombuffer(s, np.int64)
            yield batch(sums)

        sums = self.table.mapInArrow(one, "k int, s binary")
        if self.tasks * size > GOT:
            sums = sums.repartition("k").mapInArrow(add, "k int, s binary")
        out = np.zeros(size, np.int64)
        for k, s in sums.collect():
            out[k : k + PIECE] += np.frombuffer(s, np.int64)
        return out.reshape(shape)

    def only(self, *columns: str) -> Spread:
        """The table without columns that a sum does not need."""
        return self._replace(table=self.table.select(*columns))

    def map(self, f: Callable, schema: str) -> Spread:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in batches:
                parts = [f(x) for x in blocks(p)]
                if parts:
                    yield _batch(parts)

        return Spread.of(cut(self.table.mapInArrow(run, schema)))

    def close(self) -> None:
        drop(self.table)


def _frequencies(x: Rows) -> np.ndarray:
    """Rows that hold each bucket, and rows that hold any."""
    row, b = np.divmod(x.at, WIDTH)
    return np.append(np.bincount(b, minlength=WIDTH), len(np.unique(row)))


def _weighted(idf: np.ndarray, x: Rows) -> Rows:
    return x.weighted(idf)


def _project(axes: np.ndarray, x: Rows) -> np.ndarray:
    return np.rint(x.times(axes) / UNIT)


def _turned(axes: np.ndarray, x: Rows) -> np.ndarray:
    """The second moments of the rows, times the axes."""
    m = x.dense()
    return m.T @ np.rint(m @ axes / UNIT)


def _leaf(splits: list, z: np.ndarray) -> np.ndarray:
    """The cluster of each row; split k moves rows beyond its plane from its cluster to cluster k + 1."""
    at = np.zeros(len(z), np.int64)
    for k, (part, axis, mean) in enumerate(splits):
        at[(at == part) & (z @ axis > mean)] = k + 1
    return at


def _moments(z: np.ndarray) -> np.ndarray:
    """Sums of 1 and of the row, and of their products with the row."""
    z = np.hstack([np.ones((len(z), 1)), z])
    return z.T @ z


def _halves(splits: list, planes: list, z: np.ndarray) -> np.ndarray:
    """Moments on either side of a plane through each of some clusters."""
    at = _leaf(splits, z)
    parts = [(z[at == k], axis, mean) for k, axis, mean in planes]
    return np.stack([[_moments(y[y @ axis <= mean]), _moments(y[y @ axis > mean])] for y, axis, mean in parts])


def _by_centre(centres: np.ndarray, x: Rows) -> np.ndarray:
    """Sums of the rows next to each centre."""
    m = x.dense()
    near = (m @ centres).argmax(1) == np.arange(centres.shape[1])[:, None]
    return near.astype(float) @ m


def _unit(sums: np.ndarray) -> np.ndarray:
    """Rows at length 1, in units, as columns."""
    s = sums.astype(float)
    return np.rint(s / np.maximum(np.sqrt(np.square(s).sum(1, keepdims=True)), 1e-9) * UNIT).T


def _axes(rows: Held | Spread) -> np.ndarray:
    a = np.linalg.qr(np.random.default_rng(7).standard_normal((WIDTH, AXES)))[0]
    for _ in range(TURNS):
        a = np.linalg.qr(rows.sum(partial(_turned, np.rint(a * UNIT)), a.shape).astype(float))[0]
    return np.rint(a * UNIT)


def _plane(m: np.ndarray) -> tuple | None:
    """The plane through the mean, across the principal direction; none where rows do not differ."""
    mean = m[0, 1:] / max(m[0, 0], 1)
    spread, axes = np.linalg.eigh(m[1:, 1:] / max(m[0, 0], 1) - np.outer(mean, mean))
    v = axes[:, -1]
    axis = np.rint(v * np.sign(v[np.abs(v).argmax()]) * UNIT)
    return (axis, float(mean @ axis)) if spread[-1] > 1e-3 else None


def _starts(z: Held | Spread, topics: int) -> np.ndarray:
    """Sums of the rows of clusters: of those whose rows differ, the one with most rows is split next.  A pass looks at
    the halves of all clusters at once."""
    splits: list = []
    moments = {0: z.sum(_moments, (AXES + 1, AXES + 1)).astype(float)}
    planes, halves = {0: _plane(moments[0])}, {}
    while len(moments) < topics and any(planes.values()):
        big = max((k for k in moments if planes[k]), key=lambda k: (moments[k][0, 0], -k))
        if big not in halves:
            new = [(k, *p) for k, p in planes.items() if p and k not in halves]
            got = z.sum(partial(_halves, splits, new), (len(new), 2, AXES + 1, AXES + 1)).astype(float)
            halves.update((k, h) for (k, *_), h in zip(new, got))
        both = halves.pop(big)
        if not both[:, 0, 0].all():
            planes[big] = None
            continue
        splits.append((big, *planes[big]))
        for k, m in zip((big, len(splits)), both):
            moments[k], planes[k] = m, _plane(m)
    return np.stack([m[0, 1:] for m in moments.values()])


class Topics(NamedTuple):
    """Weight of every token bucket, and its part in every centre (``WIDTH`` x topics); no topics without documents."""

    idf: np.ndarray
    centres: np.ndarray

    def of_rows(self, x: Rows) -> np.ndarray:
        """The topic of each document by all of its tokens, the least on ties; -1 where nothing tells."""
        if not self.centres.shape[1]:
            return np.full(x.size, -1)
        score = x.weighted(self.idf).times(self.centres)
        return np.where(score.max(1) > 0, score.argmax(1), -1)

    def of(self, ids: np.ndarray) -> int:
        """The topic of a document by the ids of its tokens."""
        b, n = row_bytes(np.asarray(ids, np.int64))
        return int(self.of_rows(next(blocks(counts_batch([b], [n]))))[0])

    @staticmethod
    def learn(counts: Held | Spread, topics: int = TOPICS, rounds: int = FITS) -> Topics:
        *df, count = counts.only("b").sum(_frequencies, (WIDTH + 1,))
        if not count:
            return Topics(np.zeros(WIDTH), np.zeros((WIDTH, 0)))
        idf = np.log(count / np.maximum(df, 1))
        rows = counts.map(partial(_weighted, idf), "at binary, q binary, size int")
        axes = _axes(rows)
        z = rows.map(partial(_project, axes), "z binary")
        c = _unit(_starts(z, topics) @ axes.T)
        z.close()
        for _ in range(rounds):
            sums = rows.sum(partial(_by_centre, c), c.T.shape)
            now = np.where(sums.any(1), _unit(sums), c)
            if (now == c).all():
                break
            c = now
        rows.close()
        return Topics(idf, c)

    @staticmethod
    def fit(counts: np.ndarray, topics: int = TOPICS, rounds: int = FITS) -> Topics:
        """Topics of token bucket counts (documents x ``WIDTH``)."""
        rows = [(b.astype(np.uint16).tobytes(), r[b].astype(np.uint32).tobytes()) for r in counts for b in r.nonzero()]
        return Topics.learn(Held(list(blocks(counts_batch(*zip(*rows)) if rows else counts_batch([], [])))), topics, rounds)


def learn(counts: DataFrame) -> Topics:
    """Topics of all rows of a table with ``b`` and ``n``."""
    counts = counts.select("b", "n")
    if (counts.agg(F.sum(F.length("b"))).first()[0] or 0) > 2 * HELD:
        return Topics.learn(Spread.of(counts))
    return Topics.learn(Held([x for p in counts.toArrow().to_batches() for x in blocks(p)]))

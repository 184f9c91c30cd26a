"""Exact radius joins of strings under Levenshtein distance inside one task, partitioned by pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash


def levenshtein(a: str, b: str, most: int) -> int:
    """Edits between two strings, or ``most`` + 1 when there are more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    prev = [j if j <= most else most + 1 for j in range(lb + 1)]
    for i in range(1, la + 1):
        low, high = max(1, i - most), min(lb, i + most)
        cur = [most + 1] * (lb + 1)
        if i <= most:
            cur[0] = i
        ca, best = a[i - 1], cur[0]
        for j in range(low, high + 1):
            v = prev[j - 1] + (ca != b[j - 1])
            if prev[j] + 1 < v:
                v = prev[j] + 1
            if cur[j - 1] + 1 < v:
                v = cur[j - 1] + 1
            cur[j] = v
            if v < best:
                best = v
        if best > most:
            return most + 1
        prev = cur
    return min(prev[lb], most + 1)


def cells(keys: list[str], radius: int, cell: int) -> list[list[int]]:
    """Positions of ``keys`` by cell.  Beyond ``cell`` keys about sqrt(n) of them are pivots; a key goes to its nearest
    pivot and, by the triangle inequality, to every pivot within that distance plus twice the radius, so that two keys
    within the radius share a cell."""
    n = len(keys)
    if n <= cell:
        return [list(range(n))]
    step = max(2, int(n**0.5))
    pivots = sorted(keys, key=xxhash.xxh64_intdigest)[:step]
    out: list[list[int]] = [[] for _ in pivots]
    for i, k in enumerate(keys):
        ds = [levenshtein(k, p, max(len(k), len(p))) for p in pivots]
        most = min(ds) + 2 * radius
        for c, d in enumerate(ds):
            if d <= most:
                out[c].append(i)
    return out


def _bags(keys: list[str]) -> np.ndarray:
    return np.array([np.bincount(np.frombuffer(k.encode("latin-1", "replace"), np.uint8) & 31, minlength=32) for k in keys], np.int16).reshape(len(keys), 32)


def radius_join(keys: list[str], radius: int, cell: int, bag: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs i < j of ``keys`` within ``radius`` edits, each once.  ``bag`` bounds the letters that one has and the
    other lacks (at most ``radius`` anyway; fewer where only exchanged letters may take up the rest)."""
    bag = radius if bag is None else bag
    seen: set[tuple[int, int]] = set()
    parts = cells(keys, radius, cell)
    for part in parts:
        if len(part) < 2:
            continue
        m = _bags([keys[i] for i in part])
        more = np.maximum(m[:, None, :] - m[None, :, :], 0).sum(2)
        for x, y in np.argwhere(np.triu(np.maximum(more, more.T) <= bag, 1)):
            i, j = part[x], part[y]
            i, j = (i, j) if i < j else (j, i)
            if (i, j) not in seen and levenshtein(keys[i], keys[j], radius) <= radius:
                if len(parts) > 1:
                    seen.add((i, j))
                yield i, j

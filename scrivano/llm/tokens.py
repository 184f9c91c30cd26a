"""Words of texts as integer arrays, for a whole Arrow batch at once."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

LETTERS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"[^\W_]+")
LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])[-­¬‐‑–][^\S\n]*(?:\r?\n[^\S\n]*)?(?=[^\W\d_])")
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=500_000)
def word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


def fold_text(s: str) -> str:
    """Case, accents and hyphens (with a line end behind them) do not count."""
    s = LINE_HYPHEN.sub("", s)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s.casefold()


def batch_words(texts, pattern: re.Pattern, fold=None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the batch, and the offset of each text (one more than texts)."""
    offsets, out = np.zeros(len(texts) + 1, np.int64), []
    for i, t in enumerate(texts):
        if t:
            out.extend(map(word_hash, pattern.findall(fold(t) if fold else t.casefold())))
        offsets[i + 1] = len(out)
    return np.fromiter(out, np.uint64, len(out)), offsets


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (of the concatenation; the caller masks those over an end)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ (words[k : k + m] + np.uint64(k))) * MIX
            h ^= h >> np.uint64(29)
    return h

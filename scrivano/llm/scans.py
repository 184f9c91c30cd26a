"""Noise in text from scanned pages: divided words, misread glyphs, running headers, page numbers.

1. One pass reads all texts and keeps their words as numbers; from it come the counts of words, the pairs of words that
   stand near each other, and the shapes of lines that may be running headers.  The frequent vocabulary holds the words
   of relative frequency ``LEAST`` or more, which bounds it to ``1 / LEAST`` words.
2. Skip-gram vectors of the vocabulary are trained with negative samples on all pairs, word and context vectors in
   turn: with one side given, each vector of the other is a small logistic regression, solved by Newton steps in
   parallel.  word . context then estimates by how much the context speaks for the word.
3. Shapes of running headers are learned: what recurs inside single texts, numbers apart, and interrupts sentences has a
   shape (runs of words, numbers, punctuation); shapes of which a good part of the lines do so are header shapes
   wherever they stand.
4. A second pass classifies the lines.  Page numbers by form; a bare number that the word before it calls for ("con il
   progressivo / 415") is text.  A hyphen at a line end divides a word unless the corpus knows the compound and not the
   joined word.  A rare word is linked to frequent words by plausible glyph edits; one of letters only is corrected to
   the one that its context speaks for (the less is asked of it, the more usual that word is beside it), and stands
   where it speaks for none.

Reflow then drops the furniture, joins divided words, puts corrections in and joins the lines of a paragraph.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.llm.tokens import word_hash
from scrivano.session import cut, drop

LEAST, LEAST_COUNT, RATIO = 1e-5, 4, 30
WINDOW, DIM, ROUNDS, STEPS, NEGATIVES, RIDGE, CLIP, SUPPORT, USUAL = 2, 16, 3, 2, 128, 2.0, 3.0, 1.5, 0.3
HEADER_RECURS, HEADER_SHARE, HEADER_LENGTH = 2, 0.05, 120

# ---- fixed values: glyphs that scanners confuse, as (read, meant) --------------------------------------------------
GLYPHS = [
    ("0", "o"), ("@", "a"), ("l", "i"), ("c", "e"), ("f", "t"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("3", "e"), ("4", "a"), ("8", "b"), ("7", "t"),
    ("|", "l"), ("!", "i"), ("$", "s"), ("€", "e"), ("ri", "n"), ("rn", "m"), ("nn", "m"), ("m", "rn"), ("n", "ri"), ("ii", "n"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("li", "h"),
    ("i", "l"), ("e", "c"), ("t", "f"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("o", "c"), ("c", "o"), ("q", "g"), ("y", "v"), ("\\/", "v"), ("å", "a"), ("ä", "a"), ("ö", "o"), ("ı", "i"),
]
ODD = "@|!$€0123456789\\åäöı"
LIGATURES = "ﬀﬁﬂﬃﬄ"
ACCENTED = {"a": "à", "e": "èé", "i": "ì", "o": "ò", "u": "ù"}
HYPHENS = "-‐‑­¬"
ENDINGS = HYPHENS + "'"
# -------------------------------------------------------------------------------------------------------------------

PAGE = re.compile(r"(?i)^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|p(?:ag|agina|g)?\.?\s*\d{1,4}(?:\s*(?:di|/|su)\s*\d{1,4})?\.?|\d{1,4}\s*/\s*\d{1,4}|\d{1,4}\s+di\s+\d{1,4}|(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\s*$")
BARE = re.compile(r"^\s*\d{1,3}\s*$")
TOKEN = re.compile(r"(?:[^\W_]+|\\/(?=[^\W\d_]))(?:(?:[@|!$€](?=[^\W\d_])|(?<=[^\W\d_])[@$€]|\\/)[^\W_]*)*|@[^\W_]*")
CODE = re.compile(r"^(?:[A-Z]{1,4}\d+[A-Z]?|\d+|\d+[°ªº]|[IVXLC]+)$")
COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]+-[^\W\d_]+")
LIST_ITEM = re.compile(r"^\s*(?:[-–—•*·▪]|\d{1,3}[.)]|[A-Za-z]\))\s")
TITLE = re.compile(r"^\s*(?:(?:Art\.?\s*)?\d+(?:\.\d+)*\s+[A-ZÀ-Ý]|[A-ZÀ-Ý][A-ZÀ-Ý\s'’]+$)")


# ---- first pass ----------------------------------------------------------------------------------------------------

_SHAPE = re.compile(r"[\w'’]*[^\W\d_][\w'’]*|\d+|[^\w\s]")
_ODD_LETTERS = str.maketrans("@|!$€", "alise")
_NOT_LAST = frozenset(".;:,!?" + HYPHENS)
_FIRST = re.compile(r"[^\W\d_]{1,5}")
_OUTER = "0123456789 \t\r–—-|[]()."
_NO_DIGITS = {c: None for c in map(ord, _OUTER)}


def may_be_header(line: str) -> str:
    """The line without outer blanks if it could be a running header by its ends, else ''."""
    x = line.strip()
    if not 4 <= len(x) <= HEADER_LENGTH or not (x[0].isupper() or x[0].isdigit() or x[0] in "[(@|!$€") or x[-1] in _NOT_LAST or LIST_ITEM.match(x):
        return ""
    return x


def shape(line: str) -> str:
    """Runs of words as 'A' or 'a' by their first letter, numbers as '#', punctuation as it is."""
    out: list[str] = []
    for t in _SHAPE.findall(line.replace("\\/", "v").translate(_ODD_LETTERS)):
        k = "#" if t.isdigit() else "A" if t[0].isupper() or t[0].isdigit() else "a" if t[0].isalnum() else "–" if t in "–—-" else t
        if not (k in "aA" and out and out[-1] in "aA"):
            out.append(k)
    return "".join(out)


def recurring(lines: list[str]) -> dict[int, bool]:
    """Of the lines that may be headers: does the line, numbers apart, stand in the text more than once?"""
    # most lines begin with a small letter
    found = {i: x for i, line in enumerate(lines) if line and not line[0].islower() and line[-1] not in _NOT_LAST and (x := may_be_header(line))}
    if len(found) < 2:
        return dict.fromkeys(found, False)
    heads = {i: m[0].casefold() if (m := _FIRST.search(x)) else "" for i, x in found.items()}
    n = Counter(heads.values())
    keys = {i: x.casefold().translate(_NO_DIGITS) for i, x in found.items() if n[heads[i]] > 1}  # equal lines have equal first letters
    m = Counter(keys.values())
    return {i: i in keys and m[keys[i]] > 1 and len(keys[i]) >= 4 for i in found}


def _interrupts(lines: list[str], i: int) -> bool:
    before = next((x for x in reversed(lines[:i]) if x.strip() and not PAGE.match(x) and not BARE.match(x)), "").rstrip()
    after = next((x for x in lines[i + 1 :] if x.strip() and not PAGE.match(x) and not BARE.match(x)), "").lstrip()
    return bool(before) and before[-1] not in ".;:!?" and after[:1].islower()


READ = "kind int, word string, n long, m long, ids binary, hashes binary"


def _expand(of: list[list[int]], ids: np.ndarray) -> np.ndarray:
    """The concatenation of ``of[i]`` for all of ``ids``."""
    size = np.fromiter(map(len, of), np.int64, len(of))
    flat = np.fromiter((x for one in of for x in one), np.int64, int(size.sum()))
    start, n = (np.cumsum(size) - size)[ids], size[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(start - (ends - n), n) + np.arange(int(n.sum()))]


def _acyclic(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``work`` on every batch, without searches for reference cycles meanwhile: it makes many small objects and none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gc.disable()
            try:
                out = work(b)
            finally:
                gc.enable()
            yield out

    return run


def _read_batch(b: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: words, compounds ("a-b") and, as "word #", words that a number follows, with their counts.  Kind 1: the
    words of the texts of a batch as numbers (int32, 0 behind each text) and the hashes of the numbered words (int64).  Kind 2: shapes, in texts in which some line recurs and
    interrupts, with their lines and lines that do so."""
    known: dict[str, int] = {"": 0}
    chunks: dict[str, int] = {"": 0}  # blank-separated parts and their words
    inside, pairs = [[0]], {}
    shapes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    ids: list[int] = []
    for t in b["text"]:
        parts = t.casefold().split()
        for p in set(parts).difference(chunks):
            chunks[p] = len(inside)
            inside.append([known.setdefault(w, len(known)) for w in TOKEN.findall(p)])
            if "-" in p and (found := COMPOUND.findall(p)):
                pairs[chunks[p]] = found
        ids.extend(map(chunks.__getitem__, parts))
        ids.append(0)
        lines = t.split("\n")
        again = recurring(lines)
        furniture = {i for i, twice in again.items() if twice and _interrupts(lines, i)}
        for i in again if furniture else ():
            s = shapes[shape(lines[i])]
            s[0] += 1
            s[1] += i in furniture
    stream = np.asarray(ids, np.int64)
    chunk_n = np.bincount(stream, minlength=len(inside))
    stream = _expand(inside, stream)
    words = np.array(list(known), object)
    number = np.fromiter((w.isdigit() for w in known), bool, len(words))
    number[0] = True  # the end of a text
    total = np.bincount(stream, minlength=len(words))
    called = np.bincount(stream[:-1][number[stream[1:]] & (stream[1:] > 0)], minlength=len(words))
    plain, before = np.flatnonzero(~number), np.flatnonzero((called > 0) & ~number)
    compounds: Counter = Counter()
    for i, found in pairs.items():
        for x in found:
            compounds[x] += int(chunk_n[i])
    hashes = np.array([0, *map(word_hash, words[1:])], np.uint64).view(np.int64)
    names = [*words[plain], *(words[before] + " #"), *compounds, *shapes, None]
    counts = [*total[plain], *called[before], *compounds.values(), *(n for n, _ in shapes.values()), 0]
    m = np.zeros(len(names), np.int64)
    kind = np.zeros(len(names), np.int32)
    if shapes:
        m[-1 - len(shapes) : -1] = [k for _, k in shapes.values()]
        kind[-1 - len(shapes) : -1] = 2
    kind[-1] = 1
    none = [None] * (len(names) - 1)
    return pd.DataFrame({"kind": kind, "word": names, "n": np.array(counts, np.int64), "m": m, "ids": none + [stream.astype(np.int32).tobytes()], "hashes": none + [hashes.tobytes()]})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _acyclic(_read_batch)(batches)


MOST_KEYS = 6_000_000  # pairs held before they are counted


def _pairs(hashes: np.ndarray):
    """Pairs (word, later word) of the vocabulary within the window, by position in the sorted ``hashes``."""
    size = len(hashes)

    def count(keys: list[np.ndarray]) -> pd.DataFrame:
        u, n = np.unique(np.concatenate(keys), return_counts=True)
        return pd.DataFrame({"w": (u // size).astype(np.int32), "c": (u % size).astype(np.int32), "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[np.ndarray] = []
        for b in batches:
            for numbers, mine in zip(b["ids"], b["hashes"]):
                ids, own = np.frombuffer(numbers, np.int32), np.frombuffer(mine, np.int64)
                at = np.minimum(np.searchsorted(hashes, own), size - 1)
                a = np.where(hashes[at] == own, at, -1)[ids]
                for k in range(1, WINDOW + 1):
                    x, y = a[:-k], a[k:]
                    ok = (x >= 0) & (y >= 0)
                    for j in range(1, k):  # not over the end of a text
                        ok &= ids[j : j - k] != 0
                    keys.append(x[ok] * size + y[ok])
                if sum(map(len, keys)) > MOST_KEYS:
                    yield count(keys)
                    keys = []
        if keys:
            yield count(keys)

    return run


# ---- skip-gram vectors ---------------------------------------------------------------------------------------------


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Ridge logistic regression of ``y`` on the rows of ``x``."""
    v = start.astype(np.float64)
    eye = RIDGE * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 0.02))[:, None]).T @ x + eye
        v += np.linalg.solve(h, x.T @ (weight * (y - p)) - RIDGE * v)
    return v.astype(np.float32)


def _half_round(fixed: np.ndarray, moving: np.ndarray, negatives: np.ndarray):
    """The vectors of one side by those of the other: ``w, v`` from ``w, cs, ns``."""
    neg = fixed[negatives]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for w, cs, ns in zip(b["w"], b["cs"], b["ns"]):
                n = float(np.sum(ns))
                x = np.concatenate([fixed[cs], neg]).astype(np.float64)
                y = np.r_[np.ones(len(cs)), np.zeros(len(neg))]
                out.append(newton(x, y, np.r_[np.asarray(ns, float), np.full(len(neg), n / len(neg))], moving[w]))
            yield pd.DataFrame({"w": b["w"], "v": out})

    return run


def train(pairs: DataFrame, size: int, rounds: int = ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors of ``size`` words from ``pairs(w, c, n)``, each standing for both directions.  Both
    matrices are bounded by the vocabulary; negatives are drawn by frequency."""
    both = pairs.select("n", F.explode(F.array(F.struct("w", "c"), F.struct(F.col("c").alias("w"), F.col("w").alias("c")))).alias("x")).select("x.*", "n")
    lists = cut(both.groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("l"), F.sum("n").alias("t")).select("w", F.col("l.c").alias("cs"), F.col("l.n").alias("ns"), "t"))
    rnd = np.random.default_rng(seed)
    u, c = np.zeros((size, DIM), np.float32), rnd.normal(0, 1 / DIM**0.5, (size, DIM)).astype(np.float32)
    t = lists.select("w", "t").toPandas()
    if len(t):
        share = np.zeros(size)
        share[t["w"]] = t["t"] / t["t"].sum()
        for k in range(2 * rounds):
            fixed, moving = (c, u) if k % 2 == 0 else (u, c)
            got = lists.select("w", "cs", "ns").mapInPandas(_half_round(fixed, moving, rnd.choice(size, NEGATIVES, p=share)), "w int, v array<float>").toPandas().sort_values("w")
            moving[got["w"].to_numpy()] = np.stack(got["v"].to_numpy())
    drop(lists)
    return u, c


class Model:
    """Vocabulary, vectors, header shapes and the linking of rare words; bounded by ``1 / LEAST`` words."""

    def __init__(self, counts: dict[str, int], index: dict[str, int] | None = None, vectors: tuple[np.ndarray, np.ndarray] | None = None, shapes: frozenset[str] = frozenset()):
        self.counts, self.index, self.shapes = counts, index or {}, shapes
        self.tails = {k for x in shapes for k in ("aA" if x[-1] in "aA" else "0" if x[-1] == "#" else "-–—" if x[-1] == "–" else x[-1])}
        self.u, self.c = vectors or (np.zeros((0, DIM)), np.zeros((0, DIM)))
        self.rare: dict[str, int] = {}  # counts of rarer words that are usual beside their glyph neighbours
        self.most = max(counts.values(), default=0)
        self.longest = max(map(len, counts), default=0)
        self.memo: dict[str, list[tuple[str, int]]] = {}
        self.near: dict[tuple[int, int], float] = {}
        self.good: set[str] = set()
        self.fine: set[str] = set()

    def variants(self, w: str) -> list[tuple[str, int]]:
        """Frequent words one glyph edit from ``w``, or else two, with the position of the first edit."""
        if w in self.memo:
            return self.memo[w]
        found, front = {}, {w: 99}
        for _ in range(2):
            if len(w) > self.longest + 2:  # an edit takes one letter at most
                break
            step: dict[str, int] = {}
            for x, at in front.items():
                for read, meant in GLYPHS:
                    p = x.find(read)
                    while p >= 0:
                        y = x[:p] + meant + x[p + len(read) :]
                        step.setdefault(y, min(at, p))
                        p = x.find(read, p + 1)
            found = {y: p for y, p in step.items() if y != w and self.counts.get(y, 0) >= LEAST_COUNT}
            if found:
                break
            front = step
        out = sorted(found.items())
        if len(self.memo) < 300_000:
            self.memo[w] = out
        return out

    def own(self, x: str) -> int:
        return self.counts.get(x) or self.rare.get(x, 0)

    def usual(self, x: str) -> bool:
        """Among the most usual words of the corpus."""
        return self.counts.get(x, 0) * 50 >= self.most + 50

    def stands(self, w: str) -> bool:
        """No context can make ``w`` (as written) a misread word."""
        x = w.casefold()
        if CODE.match(w):
            return w != "1"
        if any(c in ODD or c in LIGATURES for c in w):
            return False
        return self.usual(x) or all(self.counts[v] < RATIO * max(self.own(x), 1) for v, _ in self.variants(x))

    def good_word(self, w: str) -> bool:
        if w in self.good:
            return True
        ok = self.stands(w)
        if ok and len(self.good) < 300_000:
            self.good.add(w)
        return ok

    def ends_so(self, last: str) -> bool:
        """Can a line that ends in this letter have a header's shape?  Words may end in digits."""
        return ("0" if last.isdigit() else "a" if last.isalpha() else last) in self.tails or (last.isdigit() and "a" in self.tails)

    def unclean(self, parts: set[str]) -> set[str]:
        """Of blank-separated parts of a text those that end in a hyphen or apostrophe, or of which a word may not stand;
        what was found out is kept."""
        out = set()
        for p in parts - self.fine:
            words = TOKEN.findall(p)  # a 1 may be a misread l before an apostrophe only
            if not words or p[-1] not in ENDINGS and "1'" not in p and "1’" not in p and all(w == "1" or self.good_word(w) for w in words):
                if len(self.fine) < 300_000:
                    self.fine.add(p)
            else:
                out.add(p)
        return out

    def support(self, v: str, context: list[str]) -> float:
        """How far the context speaks for a word."""
        i, total = self.index.get(v), 0.0
        if i is None:
            return total
        for c in context:
            j = self.index.get(c)
            if j is not None:
                x = self.near.get((i, j))
                if x is None:
                    x = max(-CLIP, min(CLIP, float(self.c[j] @ self.u[i])))
                    if len(self.near) < 300_000:
                        self.near[i, j] = x
                total += x
        return total

    def correct(self, w: str, context: list[str]) -> tuple[str, int] | None:
        """The frequent word that ``w`` misreads, in its context, and the position of the edit; None if it stands."""
        own = max(self.own(w), 1)
        mixed = any(c in ODD for c in w)
        best = None
        for v, p in self.variants(w):
            n = self.counts[v]
            if n < RATIO * own * (0.2 if mixed else 1):
                continue
            speaks = self.support(v, context)
            if not mixed and speaks + USUAL * np.log(n / (RATIO * own)) < SUPPORT:
                continue
            if best is None or np.log(n) + speaks > best[0]:
                best = (np.log(n) + speaks, v, p)
        return best[1:] if best else None


def _standing(m: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [bool(v := m.variants(w)) and all(m.counts[x] < RATIO * n for x, _ in v) for w, n in zip(b["word"], b["n"])]
            yield b[np.array(keep, bool)]

    return run


def learn(texts: DataFrame) -> Model:
    """Fit the model on all of ``texts(text)``, nulls apart."""
    read = cut(texts.where("text is not null").select("text").mapInPandas(_read, READ))
    words = cut(read.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.where("not contains(word, ' ') and not contains(word, '-')").agg(F.sum("n")).first()[0] or 0
    floor = max(LEAST_COUNT, LEAST * total)
    usual = words.where(F.col("n") >= floor).toPandas()  # at most a few / LEAST
    vocab = dict(zip(usual["word"], usual["n"].tolist()))
    plain = sorted((np.uint64(word_hash(w)).astype(np.int64), w) for w in vocab if " " not in w and "-" not in w)
    index = {w: i for i, (_, w) in enumerate(plain)}
    lines = read.where("kind = 2").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    least = max(HEADER_RECURS, LEAST * (lines.agg(F.sum("n")).first()[0] or 0))  # so at most 1 / LEAST shapes
    # words alone are no shape to know a header by
    shapes = frozenset(r["word"] for r in lines.where((F.length("word") >= 3) & (F.col("m") >= least) & (F.col("m") >= HEADER_SHARE * F.col("n"))).collect())
    vectors = None
    if plain:
        near = read.where("kind = 1").select("ids", "hashes").mapInPandas(_pairs(np.array([h for h, _ in plain], np.int64)), "w int, c int, n long").groupBy("w", "c").agg(F.sum("n").alias("n"))
        vectors = train(near, len(plain))
    m = Model(vocab, index, vectors, shapes)
    # a word that stands below the vocabulary has neighbours of less than RATIO times the floor: few words, few edits
    below = words.where((F.col("n") >= max(2.0, floor / RATIO)) & (F.col("n") < floor) & ~F.col("word").contains(" ") & ~F.col("word").contains("-"))
    rare = below.mapInPandas(_standing(m), "word string, n long").toPandas()
    m.rare = dict(zip(rare["word"], rare["n"].tolist()))
    m.memo = {}
    drop(read, words)
    return m


# ---- second pass ---------------------------------------------------------------------------------------------------


def _is_page(line: str, before: str, m: Model) -> bool:
    if PAGE.match(line):
        return True
    if not BARE.match(line):
        return False
    if line.startswith("  ") and line.rstrip("\r") != line.rstrip():
        return True
    prev = TOKEN.findall(before)
    if not prev or re.search(r"[.;:!?]\s*$", before):
        return True
    w = prev[-1].casefold()
    n = m.counts.get(w, 0)
    return not (n and m.counts.get(w + " #", 0) >= 0.3 * n)


def _headers(lines: list[str], m: Model) -> set[int]:
    """Lines of a learned header shape, and lines that recur in the text and interrupt a sentence."""
    out = set()
    for i, again in recurring(lines).items():
        if m.ends_so(lines[i].rstrip()[-1]) and shape(lines[i]) in m.shapes or again and _interrupts(lines, i):
            out.add(i)
    return out


_NONE: frozenset[str] = frozenset()
_ALONE = re.compile(r"'(?![^\W_])")  # an apostrophe that no letter follows


def inspect(text: str, m: Model) -> tuple[list[str], list[set[str] | frozenset[str]], dict[int, list[tuple[int, int, str]]], dict[int, bool]]:
    """Lines, their noise, corrections by line as (start, end, word), and for lines ending in a hyphen whether the
    word goes on without it."""
    lines = text.split("\n")
    noise: list[set[str] | frozenset[str]] = [_NONE] * len(lines)
    fixes: dict[int, list[tuple[int, int, str]]] = {}
    joins: dict[int, bool] = {}

    def note(i: int, kind: str, start: int = -1, end: int = -1, word: str = "") -> None:
        noise[i] = noise[i] | {kind}
        if start >= 0:
            fixes.setdefault(i, []).append((start, end, word))

    last = ""
    heads = _headers(lines, m)
    body = []
    for i, line in enumerate(lines):
        if len(line) <= 32 and _is_page(line, last, m):
            noise[i] = {"page"}
        elif i in heads:
            noise[i] = {"header"}
        elif line and not line.isspace():
            last = line
            body.append(i)
    bad = m.unclean(set(text.split()))
    skip_first = False
    for k, i in enumerate(body) if bad else ():
        line = lines[i]
        if not skip_first and bad.isdisjoint(line.split()):
            continue
        bare = line.rstrip()
        tail = len(bare) > 1 and bare[-1] in HYPHENS and (bare[-2].isalnum() or bare[-2] in "@$€")
        toks = list(TOKEN.finditer(line))
        start, skip_first = (1 if skip_first else 0), False
        stop = len(toks)
        if tail and toks and k + 1 < len(body):
            nxt = body[k + 1]
            right = TOKEN.search(lines[nxt])
            if right and not lines[nxt][: right.start()].strip():
                joins[i] = skip_first = _divided(toks, bare[-1], right, i, nxt, note, m)
                stop -= skip_first
        odd = bool(_ALONE.search(line))
        low: list[str] = []
        for j in range(start, stop):
            w = toks[j][0]
            if not odd and w in m.good:
                continue
            s, e = toks[j].span()
            if m.good_word(w) and line[e : e + 1] != "'":
                continue
            low = low or [x[0].casefold() for x in toks]
            _inspect_word(line, i, w, s, e, low, j, note, m)
    return lines, noise, fixes, joins


def _divided(toks: list[re.Match], mark: str, right: re.Match, i: int, nxt: int, note, m: Model) -> bool:
    """Does the hyphen at the end of a line divide a word?  Notes it, and a misreading in the joined word."""
    left = toks[-1]
    l, r = left[0].casefold(), right[0].casefold()
    joined, pair = m.counts.get(l + r, 0), m.counts.get(f"{l}-{r}", 0)
    known = m.counts.get(l, 0) >= LEAST_COUNT and m.counts.get(r, 0) >= LEAST_COUNT
    if not (joined > pair or (pair == 0 and not (known and mark == "-" and len(l) > 3 and len(r) > 3 and not m.correct(l + r, [])))):
        return False
    note(i, "hyphen")
    if not joined:
        hit = m.correct(l + r, [x[0].casefold() for x in toks[-1 - WINDOW : -1]])
        odd = any(c in ODD for c in l + r)
        if hit and hit[1] < len(l):
            note(i, "ocr", *left.span(), _cased(left[0], hit[0][: max(1, len(hit[0]) - len(r))]))
        elif hit:
            note(nxt, "ocr", right.start(), right.end(), hit[0][len(l) :])
        elif odd:
            note(i if any(c in ODD for c in l) else nxt, "ocr")
    return True


def _inspect_word(line: str, i: int, w: str, s: int, e: int, low: list[str], j: int, note, m: Model) -> None:
    """Notes a misreading of the word ``w`` at ``s`` to ``e``, the ``j``-th of the line."""
    after = line[e : e + 1]
    if CODE.match(w):
        if w == "1" and after and after in "'’" and line[e + 1 : e + 2].isalpha():
            note(i, "ocr", s, e, "l")
        return
    x = low[j]
    if any(c in LIGATURES for c in w):
        note(i, "ocr", s, e, unicodedata.normalize("NFKC", w))
        return
    if after == "'" and not line[e + 1 : e + 2].isalnum() and x[-1] in ACCENTED:  # an accent read as an apostrophe
        full = max((x[:-1] + c for c in ACCENTED[x[-1]]), key=lambda v: m.counts.get(v, 0))
        if m.counts.get(full, 0) > 3 * m.counts.get(x, 0):
            note(i, "ocr", s, e + 1, _cased(w, full))
            return
    mixed = any(c in ODD for c in x)
    if not mixed and m.usual(x):
        return
    hit = m.correct(x, low[max(0, j - WINDOW) : j] + low[j + 1 : j + 1 + WINDOW])
    if hit:
        note(i, "ocr", s, e, _cased(w, hit[0]))
    elif mixed and (sum(c.isalpha() for c in w) >= 2 and not w.isupper() or "@" in w):
        note(i, "ocr")


def _cased(was: str, now: str) -> str:
    return now.upper() if was.isupper() and len(was) > 1 else now.capitalize() if was[:1].isupper() else now


def reflow(text: str, m: Model) -> str:
    """The text as continuous paragraphs."""
    lines, noise, fixes, joins = inspect(text, m)
    out: list[str] = []
    glue, open_ = "", False
    for i, line in enumerate(lines):
        if noise[i] & {"header", "page"}:
            continue
        for s, e, w in sorted(fixes.get(i, ()), reverse=True):
            line = line[:s] + w + line[e:]
        line = re.sub(r"[^\S\n]+", " ", line).strip()
        if not line:
            if not glue:
                open_ = False
            continue
        if out and (glue or (open_ and not LIST_ITEM.match(line) and not TITLE.match(line))):
            out[-1] += ("" if glue else " ") + line
        else:
            out.append(line)
        glue = ""
        if i in joins:
            glue = "join"
            if joins[i]:
                out[-1] = out[-1][:-1]
        open_ = not (TITLE.match(line) and len(out[-1]) < 90)
    return "\n".join(out)


def _classify(m: Model):
    def work(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for src, key, text in zip(b["src"], b["item_key"], b["text"]):
            for i, kinds in enumerate(inspect(text, m)[1]):
                if kinds:
                    rows.extend((src, key, i, k) for k in sorted(kinds))
        return pd.DataFrame(rows, columns=["src", "item_key", "line_no", "noise"])

    return _acyclic(work)


def _reflowed(m: Model):
    return _acyclic(lambda b: pd.DataFrame({"src": b["src"], "item_key": b["item_key"], "text": [reflow(t, m) for t in b["text"]]}))


def noisy_lines(items: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per line and kind of noise of ``items(src, item_key, text)``: ``src, item_key, line_no, noise``.

    Null and empty texts have no noisy lines; repeated rows count once; other columns are ignored.  The model is
    learned from the items themselves unless given.
    """
    t = items.where("text is not null").select("src", "item_key", "text")
    m = model or learn(t)
    return t.mapInPandas(_classify(m), "src string, item_key string, line_no int, noise string").distinct()


def repaired(items: DataFrame, model: Model | None = None) -> DataFrame:
    """``items(src, item_key, text)`` with the text as continuous paragraphs; null texts stay out."""
    t = items.where("text is not null").select("src", "item_key", "text")
    m = model or learn(t)
    return t.mapInPandas(_reflowed(m), "src string, item_key string, text string")


def scanned_items(diagram_procedures: DataFrame, prompt_blocks: DataFrame) -> DataFrame:
    a = diagram_procedures.select(F.lit("procedure").alias("src"), F.col("procedure_id").alias("item_key"), F.col("original_text_full").alias("text"))
    b = prompt_blocks.select("block_id", F.posexplode("rag_context_blocks").alias("pos", "c")).select(
        F.lit("context").alias("src"), F.concat_ws(":", F.col("block_id").cast("string"), F.col("pos").cast("string")).alias("item_key"), F.col("c.text").alias("text")
    )
    return a.unionByName(b)

"""Parsing and pairwise comparison of names typed by people.

A name becomes a tuple of significant tokens (case, accents, articles, prepositions, honorifics, legal forms and
references such as "(art. 2)" removed; "B, A", "B - A" and "B (A)" brought back to "A B").  Two names are compared
token by token; the kinds of agreement are exact, typo (restricted Damerau-Levenshtein), abbreviation, nickname,
acronym and subset.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# ---- fixed values -------------------------------------------------------------------------------------------------
STOPWORDS = frozenset(
    "il lo la l i gli le un uno una di del dello della dell dei degli delle d per con da dal dalla e ed a al alla in su".split()
)
HONORIFICS = frozenset(
    "dott dottssa dottoressa dottore ing ingegnere arch architetto avv avvocato geom geometra rag ragioniere sig sigra "
    "signor signora prof profssa professor professoressa per on rev cav ss".split()
)
LEGAL = re.compile(r"(?i)(?<![\w.])(?:s\.?\s?r\.?\s?l|s\.?\s?p\.?\s?a|s\.?\s?n\.?\s?c|s\.?\s?a\.?\s?s|soc\.?\s?coop)\.?(?![\w.])")
FILLERS = frozenset(
    "n d|nd|n a|na|altri|altro|vari|varie|vario|soggetti terzi|terzi|vedi sopra|come sopra|da definire|da completare|da individuare|"
    "sconosciuto|sconosciuta|ignoto|non noto|non definito|non specificato|non disponibile|non applicabile|nessuno|nessuna|null|none|tutti|"
    "tutti gli interessati|interessati|ente|x|xx|xxx|s n|come da allegato|personale incaricato|personale preposto|idem|id|c s|cs|eventuali|eventuali altri|altri soggetti|soggetti|chiunque|chi di competenza|"
    "competente|ufficio competente|uffici competenti|test|prova|boh|omissis|vedi|v sopra|v s|soggetto competente|soggetti interessati|da nominare|da designare|tbd|todo|etc|ecc".split("|")
)
LONG = 30  # letters from which a word is not cut into remainders
# -------------------------------------------------------------------------------------------------------------------

_REF = re.compile(r"(?i)\(\s*(?:art|artt|all|cfr|vd|vedi|v|n|pag|comma|co|c)\b[^)]*\)|\([^)]*\d[^)]*\)|\[[^\]]*\]")
_ENTE = re.compile(r"(?i)\bdell['’ ]\s*ente\b\s*\.?\s*$")
_DOTTED = re.compile(r"^(?:[^\W\d_]\.){2,}[^\W\d_]?\.?$")
_TOKEN = re.compile(r"[^\W\d_]+(?:\.(?=[^\W\d_]{2}(?![^\W\d_]*\.[^\W\d_]))[^\W\d_]+)?\.?|\d+")
_TAIL = re.compile(r"^(.*\S)\s*\(([^()]*[^\W\d_][^()]*)\)\s*\W*$")


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFKD", s.casefold())
    return "".join(c for c in s if not unicodedata.combining(c))


class Name(NamedTuple):
    tokens: tuple[str, ...]  # significant, in canonical order
    abbr: tuple[bool, ...]  # the token was written with a full stop
    acronym: str  # letters, if the name is an acronym only
    honorific: bool
    filler: bool


EMPTY = Name((), (), "", False, True)


def _reorder(s: str) -> str:
    m = _TAIL.match(s)
    if m:
        inner = m[2].strip()
        if re.fullmatch(r"[A-Z]{2,8}|(?:[A-Z]\.){2,}", inner):
            return m[1]
        return f"{inner} {m[1]}"
    for sep in (r"\s+[-–—]\s+", r"\s*,\s+", r"\s*;\s+"):
        parts = [p for p in re.split(sep, s) if p.strip()]
        if len(parts) == 2 and all(re.search(r"[^\W\d_]", p) for p in parts):
            return f"{parts[1]} {parts[0]}"
    return s


@lru_cache(maxsize=60_000)
def parse(raw: str | None) -> Name:
    if raw is None:
        return EMPTY
    s = unicodedata.normalize("NFKC", raw).strip()
    s = re.sub(r"[\"“”«»„<>]", " ", s)
    s = re.sub(r"(?<!\w)['‘’]|['‘’](?!\w)", " ", s).strip(" \t\n-–—*•·_:;,")
    s = _REF.sub(" ", s)
    s = re.sub(r"\s+", " ", s).strip()
    flat = " ".join(re.findall(r"[^\W_]+", fold(s)))
    if not re.search(r"[^\W\d_]", s) or flat in FILLERS:
        return EMPTY
    s = LEGAL.sub(" ", s)
    s = _ENTE.sub(" ", s).strip(" -–—,:;")
    s = _reorder(s)
    one = s.strip().rstrip(":;,")
    if _DOTTED.match(one) and one.count(".") + (not one.endswith(".")) >= 3:
        return Name((), (), fold(one.replace(".", "")), False, False)
    tokens, abbr, honorific = [], [], False
    words = _TOKEN.findall(fold(re.sub(r"[’'`]", " ", s)))
    for w in words:
        dotted, bare = "." in w, w.replace(".", "")
        if (bare in HONORIFICS and (dotted or len(bare) > 3)) and not tokens and len(words) > 1:
            honorific = True
            continue
        if bare in STOPWORDS and not (dotted and len(bare) == 1):
            continue
        # a contraction such as "comm.ne" keeps its stop inside
        tokens.append(w.rstrip(".") if dotted else bare)
        abbr.append(dotted)
    if tokens and abbr[-1] and len(tokens[-1]) > 5 and "." not in tokens[-1]:
        abbr[-1] = False  # the stop closes the phrase
    if len(tokens) == 1 and not abbr[0] and 3 <= len(tokens[0]) <= 6 and (one.strip(".").isupper() or not re.search(r"[aeiou].*[aeiou]", tokens[0])):
        return Name((), (), tokens[0], honorific, False)
    if not tokens:
        return EMPTY
    return Name(tuple(tokens), tuple(abbr), "", honorific, False)


def osa(a: str, b: str, most: int) -> int:
    """Restricted Damerau-Levenshtein distance, or ``most`` + 1 when it is larger."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(lb + 1))
    for i in range(1, la + 1):
        cur = [i] + [0] * lb
        low = i
        ca = a[i - 1]
        for j in range(1, lb + 1):
            cb = b[j - 1]
            v = prev[j - 1] + (ca != cb)
            if prev[j] + 1 < v:
                v = prev[j] + 1
            if cur[j - 1] + 1 < v:
                v = cur[j - 1] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb and prev2[j - 2] + 1 < v:
                v = prev2[j - 2] + 1
            cur[j] = v
            if v < low:
                low = v
        if low > most:
            return most + 1
        prev2, prev = prev, cur
    return prev[lb] if prev[lb] <= most else most + 1


@lru_cache(maxsize=150_000)
def typo(a: str, b: str) -> int:
    """Edits between two words if that is plausible as a slip, else 9."""
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if max(len(a), len(b)) < 6 else 2
    d = osa(a, b, most)
    return d if d <= most else 9


@lru_cache(maxsize=150_000)
def abbreviates(short: str, full: str) -> bool:
    """``short`` was written with a stop: a prefix of ``full``, or first part and end of it ("comm.ne")."""
    if "." in short:
        head, tail = short.split(".", 1)
        return full.startswith(head) and full.endswith(tail) and len(head) + len(tail) < len(full)
    if len(short) < len(full) and full.startswith(short):
        return True
    return False


@lru_cache(maxsize=30_000)
def nickname(short: str, full: str) -> bool:
    """A pet form: an inner part of the given name, its last vowel free."""
    if len(short) < 4 or len(short) >= len(full):
        return False
    stem = short[:-1]
    return len(stem) >= 3 and stem in full


class Verdict(NamedTuple):
    same: int  # 0 no, 1 only if no other entity fits, 2 yes
    cost: float


NO = Verdict(0, 9.0)


def compare(a: Name, b: Name) -> Verdict:
    """Do two names name the same?"""
    if a.filler or b.filler:
        return NO
    if a.acronym or b.acronym:
        if a.acronym and b.acronym:
            return Verdict(2, 0) if a.acronym == b.acronym else NO
        acr, other = (a.acronym, b) if a.acronym else (b.acronym, a)
        initials = "".join(t[0] for t in other.tokens)
        if len(other.tokens) >= 3 and initials == acr:
            return Verdict(1, 0.6)
        # kind of body and acronym, "Settore SRAC"
        return Verdict(2, 0.1) if len(other.tokens) == 2 and other.tokens[1] == acr and other.tokens[0][0] == acr[0] else NO
    for x, y in ((a, b), (b, a)):  # an acronym typed in lower case
        if len(x.tokens) == 1 and 3 <= len(x.tokens[0]) <= 6 and len(y.tokens) >= 3 and x.tokens[0] == "".join(t[0] for t in y.tokens):
            return Verdict(1, 0.6)
    ta, tb = a.tokens, b.tokens
    if ta == tb or (len(ta) == len(tb) and sorted(ta) == sorted(tb)):
        return Verdict(2, 0)
    ja, jb = "".join(ta), "".join(tb)
    if ja == jb and not any(a.abbr) and not any(b.abbr):
        return Verdict(2, 0.05)
    for x, y in ((a, b), (b, a)):  # "Settore SRAC" against the full name
        if len(x.tokens) == 2 and len(y.tokens) >= 3 and x.tokens[0] == y.tokens[0] and x.tokens[1] == "".join(t[0] for t in y.tokens):
            return Verdict(2, 0.1)
    return _tokenwise(a, b, ja, jb)


def _tokenwise(a: Name, b: Name, ja: str, jb: str) -> Verdict:
    ta, tb = list(zip(a.tokens, a.abbr)), list(zip(b.tokens, b.abbr))
    cost, exact_len, abbr, nick, typos, strong = 0.0, 0, 0, 0, 0, 0
    for t in list(ta):  # equal words first
        if t[0] in [u[0] for u in tb] and len(t[0]) > 1:
            u = next(u for u in tb if u[0] == t[0])
            ta.remove(t)
            tb.remove(u)
            exact_len += len(t[0])
            strong += 1
    ra, rb = [], list(tb)
    for t, dot in ta:
        best = None
        for u, udot in rb:
            if dot != udot or (len(t) == 1 or len(u) == 1):
                short, full = (t, u) if (dot and not udot) or (dot == udot and len(t) < len(u)) else (u, t)
                if (dot or udot or len(short) == 1) and abbreviates(short, full):
                    c = 0.3
                    if best is None or c < best[0]:
                        best = (c, (u, udot), "abbr")
            if dot and udot and len(t) > 1 and len(u) > 1 and (abbreviates(t, u) or abbreviates(u, t)):
                best = best or (0.3, (u, udot), "abbr")
            if not dot and not udot:
                d = typo(t, u)
                if d <= 2 and (best is None or d < best[0]):
                    best = (float(d), (u, udot), "typo")
        if best is None:
            ra.append((t, dot))
        else:
            rb.remove(best[1])
            cost += best[0]
            if best[2] == "abbr":
                abbr += 1
            else:
                typos += 1
                exact_len += min(len(t), len(best[1][0]))
    if len(ra) == 1 and len(rb) == 1 and strong == 1 and exact_len >= 5 and len(a.tokens) == 2 == len(b.tokens):
        x, y = ra[0][0], rb[0][0]
        if nickname(x, y) or nickname(y, x):
            return Verdict(1, 0.4 + 0.01 * cost)
    if not ra and not rb:
        if typos > 3 or cost > 4 or (typos and exact_len < 4):
            return NO
        if abbr and strong + typos == 0 and len(a.tokens) < 3:
            return NO
        return Verdict(1, 0.1 + 0.05 * min(cost, 6)) if abbr else Verdict(2, cost)
    if not any(a.abbr) and not any(b.abbr):  # words run together or split
        most = 2 if min(len(ja), len(jb)) >= 12 else 1
        if len(a.tokens) != len(b.tokens) and osa(ja, jb, most) <= most:
            return Verdict(2, 0.5)
    if ra and rb:
        return NO
    rest, fewer = (ra, b) if ra else (rb, a)
    if fewer.honorific and len(fewer.tokens) == 1 and strong + typos == 1 and len(rest) == 1 and exact_len >= 5:
        return Verdict(1, cost + 0.6)  # honorific and surname only
    more = a if ra else b
    if len(fewer.tokens) >= 2 and len(rest) == 1 and strong + abbr + typos >= 2 and strong >= 1 and len(more.tokens) in (3, 4):
        # a body named without its kind or its seat; the matched part must hold a distinctive word
        return Verdict(1, cost + 0.7)
    if len(fewer.tokens) == 2 and len(rest) == 2 and strong == 2 and len(more.tokens) == 4:
        return Verdict(1, cost + 0.9)
    return NO


def keys(n: Name) -> list[tuple[str, str]]:
    """(space, key) rows of a name for candidate search: ``full`` spellings are compared by edit distance, ``init``
    and ``sort`` (initials as they stand and sorted) and ``any`` (words of two letters or more) by equality, a radius of 0.
    With ``slips`` they reach every pair that ``compare`` accepts."""
    out: list[tuple[str, str]] = []
    if n.filler:
        return out
    if n.acronym:
        return [("init", n.acronym)]
    t = n.tokens
    out.append(("full", "".join(t).replace(".", "")))
    if len(t) == 1 and 3 <= len(t[0]) <= 6:
        out.append(("init", t[0]))
    if len(t) >= 2:
        out.append(("init", "".join(x[0] for x in t)))
        out.append(("sort", "".join(sorted(x[0] for x in t))))
        if len(t) == 2 and len(t[1]) >= 3 and t[1][0] == t[0][0]:
            out.append(("init", t[1]))
    out += [("any", x) for x in t if len(x) > 1]
    return list(dict.fromkeys(out))


def slips(n: Name) -> list[tuple[int, str]]:
    """(number of words, word) for the words a slip may have changed.  Names without an equal word are the same only
    with as many words, or as honorific and surname beside a name of two."""
    groups = (1, 2) if n.honorific and len(n.tokens) == 1 else (len(n.tokens),)
    return [(g, x) for g in groups for x in dict.fromkeys(t for t, dot in zip(n.tokens, n.abbr) if len(t) >= 4 and not dot)]


def remainders(word: str) -> list[str]:
    """What up to two deletions leave of a word; words within two edits (``osa``) share one.  Words of more than
    ``LONG`` letters all share one key, also with the words two letters shorter."""
    if len(word) > LONG:
        return ["*"]
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out = {word} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
    return sorted(out | {"*"} if len(word) > LONG - 2 else out)


def form(n: Name) -> str:
    """A name as one string: names that differ in case, blanks or decoration only share it."""
    if n.filler:
        return ""
    if n.acronym:
        return "#" + n.acronym
    words = [t + "." * dot for t, dot in zip(n.tokens, n.abbr)]
    return ("@" if n.honorific and len(words) == 1 else "") + " ".join(words)


@lru_cache(maxsize=60_000)
def unform(s: str) -> Name:
    if not s:
        return EMPTY
    if s[0] == "#":
        return Name((), (), s[1:], False, False)
    words = s.lstrip("@").split(" ")
    abbr = tuple(w.endswith(".") for w in words)
    return Name(tuple(w.rstrip(".") for w in words), abbr, "", s[0] == "@", False)

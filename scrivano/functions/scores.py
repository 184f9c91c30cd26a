"""Heuristic scores and predicates over lines and sections; sums run in a fixed order so that thresholds hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivano.functions import lexicon as L
from scrivano.functions import text as T

NUMBERED = "(?dU)" + L.TITLE_NUMBER
BULLET = "(?U)" + L.BULLET


def numbered(c) -> Column:
    return c.rlike(NUMBERED)


def keyword(c) -> Column:
    return c.rlike(L.keyword_line())


def bullet(c) -> Column:
    return c.rlike(BULLET)


def title_score(line) -> Column:
    """0 to 1: how much a line looks like a title."""
    s = T.strip(line)
    n = T.word_count(s)
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    total = (
        add(numbered(s), 0.45) + add(keyword(s), 0.35) + add(T.starts_upper(s), 0.18) + add(T.upper_ratio(s) > 0.6, 0.18) + add(s.endswith(":"), 0.18)
        + add((n >= 1) & (n <= 10), 0.10) - add(s.rlike(L.words(L.COPULA_WORDS)), 0.15) - add(s.endswith(".") & (n > 10), 0.10)
    )
    dead = line.isNull() | (s == "") | (F.length(s) > 160) | bullet(s) | s.contains(",")
    return F.when(dead, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def looks_like_heading(line) -> Column:
    s = T.strip(F.coalesce(line, F.lit("")))
    return (s != "") & (
        numbered(s) | keyword(s) | (s.endswith(":") & (F.length(s) <= 90) & T.starts_upper(s)) | ((T.upper_ratio(s) >= 0.75) & (T.word_count(s) >= 2) & (F.length(s) <= 90))
    )


def bare_attachment(line) -> Column:
    return line.rlike("(?iu)" + L.BARE_ATTACHMENT)


def procedural_score(text, variant: str = "rag") -> Column:
    """Signals of a procedure. ``rag`` also counts imperatives; ``only`` looks for bullets on every line."""
    t = T.strip(text)
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    mark = "(?mU)" + L.BULLET if variant == "only" else BULLET
    total = add(t.rlike(mark), 0.30) + add(t.rlike(L.words(L.DEONTIC_WORDS)), 0.25) + add(t.rlike(L.words(L.SEQUENCE_WORDS)), 0.15)
    if variant == "rag":
        total = total + add(t.rlike(L.words(L.IMPERATIVE_WORDS)), 0.20)
    return F.when(text.isNull() | (t == ""), 0.0).otherwise(F.least(F.lit(1.0), total))


def title_hint(title, variant: str = "rag", stem: bool = False) -> Column:
    """Title words of procedures; stems match inside longer words only if ``stem``."""
    alt = L.TITLE_HINT_WORDS if variant == "rag" else L.TITLE_HINT_GUIDED
    return F.coalesce(title, F.lit("")).rlike(rf"(?iuU)\b({alt})" if stem else L.words(alt))


def definition_line(line) -> Column:
    s = T.strip(line)
    low = F.lower(s)
    hint = low.contains(L.DEF_HINTS[0])
    for h in L.DEF_HINTS[1:]:
        hint = hint | low.contains(h)
    return (F.length(s) >= 6) & ~bullet(s) & (defines(s) | s.rlike("(?iuU)" + L.DEF_ACRONYM) | hint)


def defines(s) -> Column:
    return s.rlike("(?dU)" + L.DEF_COLON) | s.rlike("(?dU)" + L.DEF_DASH) | s.rlike("(?diuU)" + L.DEF_MEANS)


def role_word(c, alternatives: str = L.ROLE_WORDS) -> Column:
    return F.coalesce(c, F.lit("")).rlike(L.words(alternatives))


def prefiltered(text, title, variant: str = "rag", score: Column | None = None) -> Column:
    """Sections worth a model call; ``score`` is their procedural score, if it was told before."""
    return ((procedural_score(text, variant) if score is None else score) >= 0.20) | title_hint(title, variant)

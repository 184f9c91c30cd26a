"""Definition candidates, dedupe, roles and alias maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import lexicon as L
from scrivano.functions import scores as S
from scrivano.functions import text as T


def candidates(lns: DataFrame, most: int = 260, only: bool = False) -> DataFrame:
    """Lines that look like definitions with up to two continuation lines: ``doc_id, line_no, text``."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = lns.withColumn("l0", T.strip(F.col("line"))).select("doc_id", "line_no", "l0", F.lead("l0", 1, "").over(w).alias("l1"), F.lead("l0", 2, "").over(w).alias("l2"))

    def goes_on(c):
        heading = (S.numbered(c) | ((T.upper_ratio(c) >= 0.75) & (F.length(c) <= 90) & (T.word_count(c) >= 2))) if only else (S.numbered(c) | S.keyword(c))
        return (c != "") & ~heading & ~S.bullet(c) & c.rlike("(?U)" + L.CONTINUATION) & ~S.defines(c)

    one, two = goes_on(F.col("l1")), goes_on(F.col("l2"))
    text = F.when(one & two, F.concat_ws(" ", "l0", "l1", "l2")).when(one, F.concat_ws(" ", "l0", "l1")).otherwise(F.col("l0"))
    c = s.where(S.definition_line(F.col("l0"))).select("doc_id", "line_no", text.alias("text")).where(F.length("text") >= 8)
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def by_patterns(lns: DataFrame, most: int = 120) -> DataFrame:
    """Terms and definitions by four ordered patterns; a line may give several; the first of equal ones is kept."""
    s = lns.select("doc_id", "line_no", T.strip(F.col("line")).alias("l")).where(F.length("l") >= 12)
    found = F.filter(
        F.array(*[F.struct(F.lit(i).alias("pat"), T.clean_term(F.regexp_extract("l", "(?d)" + p, 1)).alias("term"), T.squeeze(F.regexp_extract("l", "(?d)" + p, 2)).alias("definition")) for i, p in enumerate(L.TERM_PATTERNS)]),
        lambda x: (F.length(x.term) >= 2) & (F.length(x.term) <= 60) & ~F.lower(x.term).isin(*L.STOP_TERMS) & (F.length(x.definition) >= 8),
    )
    e = s.select("doc_id", "line_no", F.explode(found).alias("x")).select("doc_id", "line_no", "x.*")
    key = Window.partitionBy("doc_id", F.lower("term"), F.substring(F.lower("definition"), 1, 80)).orderBy("line_no", "pat")
    e = e.withColumn("k", F.row_number().over(key)).where("k = 1").drop("k")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "pat"))
    return e.withColumn("n", n).where(F.col("n") <= most).select("doc_id", "line_no", "pat", "term", "definition")


def keep_longest(defs: DataFrame, by_section: bool = True, most: int = 140) -> DataFrame:
    """The longest definition of each term (and section); then the longest ``most`` per document.

    ``defs(doc_id, def_id, term, definition, line_no, section_id)``; first on ties by ``def_id``.
    """
    d = defs.withColumn("k", T.squeeze(F.lower("term"))).where("k <> ''")
    keys = ["doc_id", "k"] + (["sk"] if by_section else [])
    d = d.withColumn("sk", F.lower(F.coalesce("section_id", F.lit("")))).withColumn("len", F.length(F.coalesce("definition", F.lit(""))))
    # max_by is pre-aggregated before the shuffle; a hot term needs no window
    best = d.groupBy(*keys).agg(F.max(F.struct("len", (-F.col("def_id")).alias("m"), F.struct("def_id", "term", "definition", "line_no", "section_id").alias("r"))).alias("x"))
    d = best.select("doc_id", "x.r.*", F.col("x.len").alias("len"))
    w = Window.partitionBy("doc_id").orderBy(F.col("len").desc(), F.col("line_no").asc_nulls_last(), "def_id")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("len")


def merge_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on the line: the longer text, the first source on ties."""
    x, y = a.select("doc_id", "line_no", F.col("text").alias("ta")), b.select("doc_id", "line_no", F.col("text").alias("tb"))
    keep = F.when(F.length(F.coalesce("tb", F.lit(""))) > F.length(F.coalesce("ta", F.lit(""))), F.col("tb")).otherwise(F.coalesce("ta", "tb"))
    return x.join(y, ["doc_id", "line_no"], "full_outer").select("doc_id", "line_no", keep.alias("text"))


def valid(defs: DataFrame) -> DataFrame:
    """Model output that counts as a definition."""
    t, d = T.clean_term(F.col("term")), T.squeeze(F.col("definition"))
    return defs.withColumn("term", t).withColumn("definition", F.substring(d, 1, 1200)).where(
        F.length("term").between(2, 60) & (F.length("definition") >= 8) & F.col("line_no").isNotNull() & ~F.col("term").rlike("(?iu)" + L.DEF_BAD_TERM)
    )


def allowed_agents(defs: DataFrame, most: int = 40) -> DataFrame:
    """Distinct terms with a role word in the term or its definition, in first-seen order."""
    d = defs.withColumn("term", T.strip(F.col("term"))).where((F.col("term") != "") & (S.role_word(F.col("term")) | S.role_word(F.col("definition"))))
    first = d.groupBy("doc_id", F.lower("term").alias("k")).agg(F.min(F.struct("def_id", "term")).alias("f"))
    w = Window.partitionBy("doc_id").orderBy("f.def_id", "k")
    return first.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("doc_id", "pos", F.col("f.term").alias("agent"))


def alias_map(norm: DataFrame, most: int = 10) -> DataFrame:
    """``doc_id, alias, canonical`` from agents: term and aliases; the first writer of an alias wins."""
    a = norm.where(F.col("is_agent") & (T.strip(F.coalesce("canonical_agent", F.lit(""))) != ""))
    term = T.strip(F.coalesce("term", F.lit("")))
    names = F.slice(F.concat(F.when(term != "", F.array(term)).otherwise(F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>"))), 1, most)
    e = a.select("doc_id", "norm_id", T.strip(F.col("canonical_agent")).alias("canonical"), F.posexplode(names).alias("pos", "name"))
    e = e.withColumn("alias", T.strip(F.lower("name"))).where("alias is not null and alias <> ''")
    return e.groupBy("doc_id", "alias").agg(F.min(F.struct("norm_id", "pos", "canonical")).alias("f")).select("doc_id", "alias", F.col("f.canonical").alias("canonical"))


def acronym_map(defs: DataFrame) -> DataFrame:
    """Aliases from definitions themselves: acronyms and role words; the last writer wins."""
    t, d = T.strip(F.col("term")), T.strip(F.col("definition"))
    head = F.regexp_replace(F.substring(d, 1, 80), r"\.+$", "")
    acr = t.rlike("^[A-Z0-9]{2,12}$") & (F.length(d) >= 8)
    role = F.lower(t).isin("operatore", "richiedente", "utente", "cittadino")
    val = F.when(acr, F.concat(t, F.lit(" ("), head, F.lit(")"))).when(role, T.strip(head))
    e = defs.where((t != "") & (d != "")).select("doc_id", "def_id", F.lower(t).alias("alias"), val.alias("canonical")).where("canonical is not null")
    return e.groupBy("doc_id", "alias").agg(F.max_by("canonical", "def_id").alias("canonical"))


def ground(agents: DataFrame, aliases: DataFrame) -> DataFrame:
    """``agents(doc_id, agent)`` with ``grounded``: the alias map's name, else the normalised agent."""
    a = agents.withColumn("base", T.agent_name(F.col("agent"))).withColumn("alias", F.lower("base"))
    return a.join(aliases, ["doc_id", "alias"], "left").withColumn("grounded", F.coalesce("canonical", "base")).drop("alias", "base", "canonical")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)

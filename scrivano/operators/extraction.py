"""Definitions of whole documents: candidates, the model's answer, validation, and the two ways to normalise them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import lexicon as L
from scrivano.functions import scores as S
from scrivano.functions import text as T
from scrivano.operators import definitions, models, nearest, outline
from scrivano.session import cut

MOST_CANDIDATES, MOST_ASKED, ASKED_CHARS, MOST_DEFINITIONS, MOST_TERMS = 260, 180, 380, 140, 60
DEFINITIONS = "struct<definitions:array<struct<term:string,definition:string,line_no:string>>>"


def semantic_candidates(lns: DataFrame) -> DataFrame:
    """Lines nearest to the five definition queries, the first of each line in query order: ``doc_id, line_no, text``.

    Each query takes 50 lines and all of them 180, fewer for longer documents; lines below eight characters don't count.
    """
    text = T.strip(F.col("line"))
    doc = lns.groupBy("doc_id").agg(F.collect_list(F.when(text != "", F.struct("line_no", text.alias("text")))).alias("ls"), F.count("*").cast("int").alias("n"))
    doc = doc.select("doc_id", "ls", T.adaptive_k(F.col("n"), 50, 18, 50).alias("k"), T.adaptive_k(F.col("n"), 180, 80, 180).alias("most"))
    return doc.mapInArrow(nearest.first_hits(list(L.DEFINITION_QUERIES), 8), "doc_id string, line_no int, text string")


def asked_candidates(lns: DataFrame, variant: str = "rag", booster: bool = True) -> DataFrame:
    """What the model is asked about, ``doc_id, line_no, text`` in line order: with retrieval the heuristic and semantic
    candidates merged, at most 180 of 380 characters; without it the 260 heuristic ones as they are."""
    c = definitions.candidates(lns, MOST_CANDIDATES, only=variant == "only")
    if variant != "rag":
        return c
    if booster:
        c = definitions.merge_candidates(c, semantic_candidates(lns))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return c.withColumn("place", place).where(F.col("place") <= MOST_ASKED).select("doc_id", "line_no", T.truncate(F.col("text"), ASKED_CHARS).alias("text"))


def line_number(c) -> Column:
    """An integer, or a text of digits, as a line number; null for anything else."""
    return F.when(T.strip(c).rlike(r"^[+-]?\d+$"), T.strip(c).try_cast("int"))


def extract(lns: DataFrame, secs: DataFrame, completer: models.Completer, variant: str = "rag", booster: bool = True) -> DataFrame:
    """Definitions found by the model: ``doc_id, def_id, term, definition, line_no, section_id, rank``.

    Answers that are no definition (``definitions.valid``) are dropped; the longest of a term and section stays, at most
    140 a document.  ``def_id`` numbers a document's answers in their order.
    """
    c = asked_candidates(lns, variant, booster)
    items = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("candidates"))
    prompts = items.select("doc_id", F.lit("definitions").alias("stage"), "candidates", models.definitions_prompt(F.col("candidates"), MOST_ASKED if variant == "rag" else MOST_CANDIDATES).alias("prompt"))
    got = completer.complete(prompts).select("doc_id", F.posexplode(F.from_json(T.json_object(F.col("response")), DEFINITIONS)["definitions"]).alias("pos", "d"))
    raw = got.select("doc_id", F.col("pos").cast("long").alias("def_id"), "d.term", "d.definition", line_number(F.col("d.line_no")).alias("line_no"))
    raw = cut(definitions.valid(raw.where("term is not null and definition is not null")))
    found = raw.join(outline.line_sections(raw.select("doc_id", "line_no").distinct(), secs), ["doc_id", "line_no"], "left")
    return definitions.keep_longest(found, most=MOST_DEFINITIONS)


def first_terms(defs: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The first ``most`` definitions of a document by rank, then the first of each term among them."""
    d = defs.where(F.col("rank") <= most).withColumn("term", T.strip(F.col("term"))).where("term <> ''")
    k = F.row_number().over(Window.partitionBy("doc_id", F.lower("term")).orderBy("rank"))
    return d.withColumn("k", k).where("k = 1").drop("k")


def section_lookup(rows: DataFrame, secs: DataFrame) -> DataFrame:
    """``rows(doc_id, section_id, ...)`` with ``section_title`` and ``section_path``, '' where unknown; of sections of
    one id the last counts."""
    last = secs.groupBy("doc_id", "section_id").agg(F.max_by(F.struct("title", "path"), "sec_idx").alias("s"))
    return rows.join(last, ["doc_id", "section_id"], "left").withColumn("section_title", F.coalesce(T.strip(F.col("s.title")), F.lit(""))).withColumn("section_path", F.coalesce(T.strip(F.col("s.path")), F.lit(""))).drop("s")


NORMALIZED = ("doc_id", "norm_id", "term", "normalized", "is_agent", "canonical_agent", "aliases", "status", "section_id", "section_title", "section_path", "line_no")


def normalize_by_summary(defs: DataFrame, secs: DataFrame, completer: models.Completer) -> DataFrame:
    """A short summary of each definition; terms that name a role are agents, named by their summary."""
    d = first_terms(defs).where("definition is not null and trim(definition) <> ''")
    prompts = d.withColumn("stage", F.lit("summary")).withColumn("prompt", models.summary_prompt(F.col("term"), F.col("definition")))
    d = completer.complete(prompts).withColumn("summary", models.summary_of(F.col("response"), F.col("term")))
    role = S.role_word(F.col("term"), L.ROLE_HINT_WORDS) | S.role_word(F.col("summary"), L.ROLE_HINT_WORDS)
    agent = F.when(role, F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("term"))).otherwise("")
    d = section_lookup(d, secs)
    return d.select(
        "doc_id", F.col("def_id").alias("norm_id"), "term", F.substring("summary", 1, 160).alias("normalized"), role.alias("is_agent"), F.substring(agent, 1, 80).alias("canonical_agent"),
        F.array("term").alias("aliases"), F.lit("ok").alias("status"), "section_id", "section_title", "section_path", "line_no",
    )


ANSWER = "struct<normalized:string,is_agent:boolean,canonical_agent:string,aliases:array<string>>"


def normalize_by_answer(defs: DataFrame, completer: models.Completer) -> DataFrame:
    """Name, role and aliases as the model gives them for a term and its definition; the term comes first among at most
    eight aliases."""
    d = first_terms(defs)
    evidence = F.array(F.struct(F.lit("definition").alias("kind"), F.substring(F.coalesce("definition", F.lit("")), 1, 900).alias("text"), F.struct("term", "line_no").alias("meta")))
    prompts = d.withColumn("stage", F.lit("normalize")).withColumn("prompt", models.normalize_prompt(F.col("term"), evidence))
    d = completer.complete(prompts).withColumn("a", F.from_json(T.json_object(F.col("response")), ANSWER))
    named = F.filter(F.transform(F.slice(F.coalesce("a.aliases", F.array().cast("array<string>")), 1, 8), T.strip), lambda x: x.isNotNull() & (x != ""))
    aliases = F.when(F.array_contains(named, F.col("term")), F.array_distinct(named)).otherwise(F.concat(F.array("term"), F.array_distinct(named)))
    text = lambda c, n: F.substring(T.strip(F.coalesce(F.col(c), F.lit(""))), 1, n)
    return d.select(
        "doc_id", F.col("def_id").alias("norm_id"), "term", text("a.normalized", 160).alias("normalized"), F.coalesce("a.is_agent", F.lit(False)).alias("is_agent"), text("a.canonical_agent", 80).alias("canonical_agent"),
        F.slice(aliases, 1, 8).alias("aliases"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("section_id"), F.lit("").alias("section_title"), F.lit("").alias("section_path"), "line_no",
    )


def match_definition(terms: DataFrame, defs: DataFrame) -> DataFrame:
    """``terms(doc_id, term)`` with the ``definition`` of the first of ``defs(doc_id, def_id, term, definition)`` that
    has the term in any case, null without one or for a blank term."""
    key = lambda: T.strip(F.lower("term"))
    first = defs.withColumn("k", key()).where("k <> ''").groupBy("doc_id", "k").agg(F.min_by("definition", "def_id").alias("definition"))
    return terms.withColumn("k", key()).join(first, ["doc_id", "k"], "left").drop("k")

"""Model stages: prompts out, answers in.  The model is pluggable: replayed answers or deterministic rules offline."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivano.functions import text as T

PROMPT_CHARS = 360_000


class Completer(ABC):
    """Answers ``prompts(prompt_id, stage, prompt)`` with a ``response`` column, '' where there is none."""

    @abstractmethod
    def complete(self, prompts: DataFrame) -> DataFrame: ...


class ReplayCompleter(Completer):
    """Answers from a table ``(prompt_sha256, stage, response)``."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def complete(self, prompts: DataFrame) -> DataFrame:
        p = prompts.withColumn("prompt_sha256", F.sha2("prompt", 256))
        a = self.answers.groupBy("prompt_sha256", "stage").agg(F.max("response").alias("response"))
        return p.join(a, ["prompt_sha256", "stage"], "left").withColumn("response", F.coalesce("response", F.lit(""))).drop("prompt_sha256")


class RuleCompleter(Completer):
    """Answers by a rule per stage: the column it needs and an expression over the prompts table."""

    def __init__(self, rules: dict[str, tuple[str, Column]]):
        self.rules = rules

    def complete(self, prompts: DataFrame) -> DataFrame:
        out = F.lit("")
        for stage, (needs, rule) in self.rules.items():
            if needs not in prompts.columns:
                continue
            out = F.when(F.col("stage") == stage, rule).otherwise(out)
        return prompts.withColumn("response", F.coalesce(out, F.lit("")))


def cap(c, most: int = PROMPT_CHARS) -> Column:
    return T.truncate(c, most)


def first_items(arr, n: int) -> Column:
    """JSON of the first n items of an array, [] when it is empty or null."""
    return F.coalesce(F.to_json(F.slice(arr, 1, n)), F.lit("[]"))


def shrunk(blocks: Column, count: int = 12, most: int = 650) -> Column:
    """Context blocks ``(id, kind, text)`` cut for a prompt."""
    return F.transform(F.slice(blocks, 1, count), lambda b: F.struct(b.id.alias("evidence_id"), b.kind.alias("kind"), T.truncate(b.text, most).alias("text")))


def titles_prompt(items: Column, examples: Column) -> Column:
    return cap(F.concat(
        F.lit("Quali di queste righe sono titoli? Rispondi con JSON {\"titles\":[{\"line_no\",\"is_title\",\"level\",\"clean_title\"}]}.\nEsempi: "), first_items(examples, 4), F.lit("\nRighe: "), F.to_json(items)
    ))


def chunk_titles_prompt(chunk: Column) -> Column:
    return cap(F.concat(F.lit("Elenca i titoli di questo brano, livello da 1 a 3. Rispondi con JSON {\"titles\":[{\"title\",\"level\"}]}.\nBrano: "), chunk))


def section_prompt(title: Column, path: Column, text: Column, examples: Column, similar: Column) -> Column:
    """``examples(label, ...)``: three of each label are shown, and two similar passages."""
    of = lambda label: first_items(F.filter(examples, lambda x: x.label == label), 3)
    return cap(F.concat(
        F.lit("La sezione descrive una procedura? Rispondi con JSON {\"is_procedure\",\"confidence\",\"action_candidates\",\"reasons\"}.\nTitolo: "), title, F.lit("\nPercorso: "), path,
        F.lit("\nEsempi procedurali: "), of("procedural_section_pattern"), F.lit("\nAltri esempi: "), of("nonprocedural_section_pattern"), F.lit("\nPassi simili: "), first_items(similar, 2), F.lit("\nTesto: "), T.trim_section(text),
    ))


CONTEXT_CHARS, SIMILAR_CHARS = 120_000, 18_000


def minimal_prompt(title: Column, path: Column, text: Column, context: Column, similar: Column) -> Column:
    return cap(F.concat(
        F.lit("Riassumi la procedura in passi brevi, solo da questa sezione. Rispondi con JSON {\"status\",\"steps\":[\"...\"],\"notes\":[\"...\"]}.\nTitolo: "), title, F.lit("\nPercorso: "), path, F.lit("\nTesto: "), T.trim_section(text),
        F.lit("\nContesto: "), T.truncate(F.to_json(context), CONTEXT_CHARS), F.lit("\nProcedure simili, solo per la forma: "), T.truncate(first_items(similar, 3), SIMILAR_CHARS),
    ))


STEP_TYPES = (
    "event_start", "event_end", "event_timer", "event_intermediate", "event_message", "event_signal", "event_conditional", "event_link",
    "activity_task", "activity_subprocess", "gateway_exclusive", "gateway_parallel", "gateway_inclusive", "gateway_event",
)


def steps_prompt(title: Column, path: Column, text: Column, agents: Column, context: Column, definitions: Column, examples: Column, actions: Column, similar: Column) -> Column:
    """Shows 16 definitions, 24 agents, 3 examples, 8 actions, 10 context blocks and 3 similar procedures at most."""
    return cap(F.concat(
        F.lit(f"Estrai i passi, di tipo {', '.join(STEP_TYPES)}. Rispondi con JSON {{\"status\",\"notes\",\"steps\":[{{\"id\",\"type\",\"agent\",\"description_synthetic\",\"meta\"}}]}}.\nTitolo: "), title, F.lit("\nPercorso: "), path,
        F.lit("\nDefinizioni: "), first_items(definitions, 16), F.lit("\nAttori: "), first_items(agents, 24), F.lit("\nEsempi: "), first_items(examples, 3), F.lit("\nAzioni: "), first_items(actions, 8),
        F.lit("\nContesto: "), first_items(context, 10), F.lit("\nProcedure simili: "), first_items(similar, 3), F.lit("\nTesto: "), T.trim_section(text),
    ))


def definitions_prompt(candidates: Column, most: int = 180) -> Column:
    return cap(F.concat(F.lit("Estrai le definizioni. Rispondi con JSON {\"definitions\":[{\"term\",\"definition\",\"line_no\"}]}.\nRighe: "), first_items(candidates, most)))


def summary_prompt(term: Column, definition: Column) -> Column:
    return cap(F.concat(F.lit("Riassumi in al massimo otto parole. Rispondi con JSON {\"summary\"}.\nTermine: "), term, F.lit("\nDefinizione: "), definition))


def normalize_prompt(term: Column, evidence: Column) -> Column:
    return cap(F.concat(F.lit("Normalizza la definizione. Rispondi con JSON {\"term\",\"normalized\",\"is_agent\",\"canonical_agent\",\"aliases\"}.\nTermine: "), term, F.lit("\nEvidenze: "), first_items(evidence, 12)))


def summary_of(response: Column, term: Column, words: int = 8) -> Column:
    """The first line of a summary, at most ``words`` words; the term where the answer is empty."""
    s = T.squeeze(F.split(F.get_json_object(T.json_object(response), "$.summary"), "\n")[0])
    return F.coalesce(F.nullif(F.array_join(F.slice(F.split(s, " "), 1, words), " "), F.lit("")), term)


TITLES = "struct<titles:array<struct<line_no:int,is_title:boolean,level:int,clean_title:string>>>"


def titles_of(answers: DataFrame) -> DataFrame:
    """Accepted titles of ``answers(doc_id, response)``: ``doc_id, start_line, level, title``."""
    t = answers.select("doc_id", F.explode(F.from_json(T.json_object(F.col("response")), TITLES)["titles"]).alias("t")).select("doc_id", "t.*")
    t = t.withColumn("title", T.strip(F.coalesce("clean_title", F.lit(""))))
    return t.where("is_title and title <> '' and line_no is not null").select("doc_id", F.col("line_no").alias("start_line"), F.coalesce("level", F.lit(2)).alias("level"), "title")

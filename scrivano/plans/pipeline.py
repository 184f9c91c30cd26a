"""The three document pipelines end to end, over all documents at once.

``rag``: titles confirmed by the model with examples from the pattern bank, definitions with the semantic booster,
sections classified with examples, context of every procedure retrieved from its own document, similar procedures from
the bank.  ``guided``: the same stages without any retrieval.  ``only``: titles from blind character chunks, in character
coordinates.  Every model stage is a prompts table, an answer and a parse; answers are cut to storage, so a run is a
chain of restartable stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivano.functions import lexicon as L
from scrivano.functions import scores as S
from scrivano.functions import text as T
from scrivano.operators import chunks, context, definitions, extraction, graph, lines, memory, models, outline
from scrivano.session import cut
from scrivano.sources.readers import Config

NONE = "cast(array() as array<string>)"


def rules() -> models.RuleCompleter:
    """Deterministic answers: titles by score, procedures by signals, one step per list item, definitions by form."""
    title = F.transform("items", lambda x: F.struct(x.line_no.alias("line_no"), (x.score >= 0.45).alias("is_title"), F.when(T.upper_ratio(x.candidate) >= 0.75, 1).otherwise(2).alias("level"), x.candidate.alias("clean_title")))
    found = F.filter(F.transform(F.split("chunk", "\n"), T.strip), lambda s: S.title_score(s) >= 0.45)
    items = F.filter(F.transform(F.split("text", "\n"), T.strip), S.bullet)
    plain = lambda s: F.regexp_replace(s, S.BULLET, "")
    steps = F.transform(items, lambda s, i: F.struct((i + 1).cast("string").alias("id"), F.when(s.rlike(r"(?iu)\bverifica"), "gateway_exclusive").otherwise("activity_task").alias("type"), F.lit("operatore").alias("agent"), plain(s).alias("description_synthetic"), F.lit("").alias("meta")))
    form = "(?d)" + L.TERM_PATTERNS[3]
    defs = F.filter(F.transform("candidates", lambda x: F.struct(F.regexp_extract(x.text, form, 1).alias("term"), F.regexp_extract(x.text, form, 2).alias("definition"), x.line_no.alias("line_no"))), lambda x: x.term != "")
    role = S.role_word(F.col("term"), L.ROLE_HINT_WORDS)
    return models.RuleCompleter({
        "titles": ("items", F.to_json(F.struct(title.alias("titles")))),
        "chunk_titles": ("chunk", F.to_json(F.struct(F.transform(found, lambda s: F.struct(s.alias("title"), F.when(T.upper_ratio(s) >= 0.75, 1).otherwise(2).alias("level"))).alias("titles")))),
        "definitions": ("candidates", F.to_json(F.struct(defs.alias("definitions")))),
        "summary": ("definition", F.to_json(F.struct(F.array_join(F.slice(F.split(T.squeeze(F.col("definition")), " "), 1, 8), " ").alias("summary")))),
        "normalize": ("definition", F.to_json(F.struct(F.col("definition").alias("normalized"), role.alias("is_agent"), F.when(role, F.col("term")).otherwise("").alias("canonical_agent"), F.array("term").alias("aliases")))),
        "section": ("score", F.to_json(F.struct((F.col("score") >= 0.20).alias("is_procedure"), F.col("score").alias("confidence")))),
        "minimal": ("text", F.to_json(F.struct(F.lit("complete").alias("status"), F.transform(items, plain).alias("steps"), F.expr(NONE).alias("notes")))),
        "steps": ("text", F.to_json(F.struct(F.lit("Complete").alias("status"), steps.alias("steps")))),
    })


def titles(docs: DataFrame, lns: DataFrame, completer: models.Completer, examples: DataFrame | None = None) -> DataFrame:
    items = lines.title_items(lns).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line_no", "candidate", "score"))).alias("items"))
    shown = F.expr(NONE)
    if examples is not None:
        items, shown = items.join(examples, "doc_id", "left"), F.col("examples")
    prompts = items.select("doc_id", F.lit("titles").alias("stage"), "items", models.titles_prompt(F.col("items"), shown).alias("prompt"))
    return models.titles_of(cut(completer.complete(prompts).select("doc_id", "response")))


def chunk_titles(docs: DataFrame, completer: models.Completer, least: int = 2000, largest: int = 3000, most: int = 30) -> DataFrame:
    """Titles found inside blind chunks, in character coordinates; near repeats of a title are one."""
    ch = chunks.blind_chunks(docs, least, largest)
    prompts = ch.select("doc_id", "chunk_id", "start_char", F.col("text").alias("chunk"), F.lit("chunk_titles").alias("stage"), models.chunk_titles_prompt(F.col("text")).alias("prompt"))
    form = "struct<titles:array<struct<title:string,level:int>>>"
    got = completer.complete(prompts).select("doc_id", "chunk_id", "start_char", "chunk", F.explode(F.from_json(T.json_object(F.col("response")), form)["titles"]).alias("t"))
    got = got.withColumn("title", T.strip(F.coalesce("t.title", F.lit("")))).withColumn("level", F.coalesce("t.level", F.lit(2))).where("title <> ''")
    got = got.withColumn("at", F.col("start_char") + F.greatest(F.position(F.col("title"), F.col("chunk")) - 1, F.lit(0)))
    key = Window.partitionBy("doc_id", F.lower(T.squeeze(F.col("title"))), "level", F.floor(F.col("at") / 10)).orderBy("chunk_id", "at")
    got = got.withColumn("k", F.row_number().over(key)).where("k = 1")
    n = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("at"))
    got = got.withColumn("n", n).where(F.col("n") <= most)
    return got.select("doc_id", F.col("at").cast("int").alias("start_line"), F.greatest(F.lit(1), F.least(F.lit(3), F.col("level"))).alias("level"), "title")


def _bodies(docs: DataFrame, lns: DataFrame, completer: models.Completer, variant: str, config: Config, patterns: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outline, sections and section texts."""
    if variant == "only":
        found = chunk_titles(docs, completer, config.only_llm_min_chars_per_chunk, config.only_llm_max_chars_per_chunk, config.only_llm_max_titles_per_chunk)
        tree = cut(outline.outline(found, chars=True))
        secs = outline.sections(tree, docs.select("doc_id", F.length("text").alias("n_lines")))
        text = F.substr(F.col("text"), F.col("start_line") + 1, F.greatest(F.col("end_line") - F.col("start_line") + F.when(F.col("title") == "DOCUMENTO", 1).otherwise(0), F.lit(0)))
        return tree, secs, secs.join(docs, "doc_id").withColumn("text", T.strip(text)).where("text <> ''")
    examples = memory.title_examples(lines.title_candidates(lns), patterns) if patterns is not None else None
    tree = cut(outline.outline(titles(docs, lns, completer, examples)))
    secs = outline.sections(tree, lns.groupBy("doc_id").agg(F.count("*").alias("n_lines")))
    return tree, secs, outline.section_texts(secs, lns)


def _classified(body: DataFrame, completer: models.Completer, variant: str, patterns: DataFrame | None, passages: DataFrame | None) -> DataFrame:
    """Sections worth asking about, with the model's verdict."""
    asked = body.where(S.prefiltered(F.col("text"), F.col("title"), variant, F.col("score")))
    examples, similar = F.expr("cast(array() as array<struct<label:string>>)"), F.expr(NONE)
    if patterns is not None:
        asked, examples = asked.join(memory.section_examples(asked, patterns), "section_id", "left"), F.col("examples")
    if passages is not None:
        asked, similar = asked.join(memory.local_similar(asked, passages), "section_id", "left"), F.col("similar")
    keep = ["doc_id", "section_id", "sec_idx", "start_line", "end_line", "title", "path", "text"]
    prompts = asked.select(*keep, "score", F.lit("section").alias("stage"), models.section_prompt(F.col("title"), F.col("path"), F.col("text"), examples, similar).alias("prompt"))
    answer = F.from_json(T.json_object(F.col("response")), "struct<is_procedure:boolean,confidence:double,reasons:array<string>>")
    got = completer.complete(prompts).withColumn("a", answer)
    return cut(got.select(*keep, F.coalesce("a.is_procedure", F.lit(False)).alias("is_procedure"), F.col("a.confidence").alias("confidence"), F.col("a.reasons").alias("reasons")))


def blocks_of(ctx: DataFrame) -> DataFrame:
    """``section_id, blocks`` of a context table, at most twelve blocks in place order."""
    return ctx.groupBy("section_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind", "id", "text"))), lambda x: F.struct(x.kind.alias("kind"), x.id.alias("id"), x.text.alias("text"))).alias("blocks"))


BLOCKS = "array<struct<kind:string,id:string,text:string>>"
SIMILAR = "array<struct<id:string,source_doc:string,section_title:string,section_path:string,status:string,text:string,score:string>>"


def run(
    documents: DataFrame, variant: str = "rag", completer: models.Completer | None = None, config: Config | None = None, patterns: DataFrame | None = None, procedures: DataFrame | None = None,
    evaluation: bool = False, local_similar: bool = False,
) -> dict[str, DataFrame]:
    """``outline, sections, definitions, normalized, agents, aliases, flags, context, records, diagrams, steps, links,
    new_patterns, new_procedures, stats`` of all documents, and ``chunks`` for ``only``.

    ``patterns`` and ``procedures`` are the banks to read (``memory.PATTERNS``, ``memory.PROCEDURES``); they are read only
    by ``rag``, with ``use_crossdoc_patterns`` and not under ``evaluation``.  What a batch would give to the banks comes
    out as ``new_patterns`` and ``new_procedures``, empty if the banks are frozen or not to be used.
    """
    completer, config = completer or rules(), config or Config()
    rag, only = variant == "rag", variant == "only"
    reads = rag and config.use_crossdoc_patterns and not evaluation
    bank, known = (patterns, procedures) if reads else (None, None)
    docs = cut(lines.documents(documents, rstrip=not only))  # every stage reads the texts
    lns = lines.lines(docs)
    tree, secs, body = _bodies(docs, lns, completer, variant, config, bank)
    n_lines = lns.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_lines"))
    secs = cut(secs)
    defs = cut(extraction.extract(lns, secs.limit(0) if only else secs, completer, variant))
    norm = cut(extraction.normalize_by_summary(defs, secs, completer) if rag else extraction.normalize_by_answer(defs, completer))
    agents = definitions.allowed_agents(defs.withColumn("def_id", F.col("rank")))
    aliases = definitions.alias_map(norm)
    pieces = cut(chunks.passages(lns)) if rag else None
    body = cut(body.withColumn("score", S.procedural_score(F.col("text"), variant)))
    flags = _classified(body, completer, variant, bank, pieces if rag and local_similar else None)
    procs = flags.where("is_procedure").withColumn("procedure_id", F.concat_ws("_", "doc_id", F.lit("proc"), F.lpad("sec_idx", 3, "0")))
    ctx = None
    if rag:
        spans = pieces.select("doc_id", F.col("id").alias("span_id"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
        homes = outline.span_sections(spans, secs).select("doc_id", F.col("span_id").alias("id"), "section_id")
        ctx = cut(context.section_context(procs, cut(agents), cut(chunks.definition_chunks(defs)), cut(pieces.join(homes, ["doc_id", "id"])), outline.parent_chunks(body), cut(n_lines)))
        procs = procs.join(blocks_of(ctx), "section_id", "left")
    procs = procs.withColumn("blocks", F.coalesce("blocks", F.array().cast(BLOCKS)) if rag else F.array().cast(BLOCKS))
    if known is not None:
        procs = procs.join(memory.similar_procedures(procs, known), "section_id", "left")
    procs = cut(procs.withColumn("similar", F.coalesce("similar", F.array().cast(SIMILAR)) if known is not None else F.array().cast(SIMILAR)))
    records = _records(procs, completer)
    raw = _asked_steps(procs, agents, defs, completer)
    steps = cut(_grounded(graph.coerce_steps(raw), procs, aliases))
    links = graph.link_steps(steps)
    writes = rag and config.use_crossdoc_patterns and not config.freeze_global_patterns and not evaluation
    spark = documents.sparkSession
    out = {
        "outline": tree, "sections": secs, "definitions": defs, "normalized": norm, "agents": agents, "aliases": aliases, "flags": flags,
        "context": ctx if rag else spark.createDataFrame([], "section_id string, place int, kind string, id string, text string"),
        "records": records, "diagrams": _diagrams(procs, raw, steps, links), "steps": steps, "links": links,
        "new_patterns": memory.pattern_rows(tree, flags) if writes else spark.createDataFrame([], memory.PATTERNS),
        "new_procedures": memory.procedure_rows(records) if writes else spark.createDataFrame([], memory.PROCEDURES),
    }
    out["stats"] = _stats(docs, n_lines, out)
    if only:
        out["chunks"] = chunks.blind_chunks(docs, config.only_llm_min_chars_per_chunk, config.only_llm_max_chars_per_chunk)
    return out


def _records(procs: DataFrame, completer: models.Completer) -> DataFrame:
    """Procedures as short texts: ``procedure_id, doc_id, sec_idx, section_title, section_path, start_line, end_line,
    status, steps, notes, evidence_chunk_ids``."""
    prompts = procs.withColumn("stage", F.lit("minimal")).withColumn("prompt", models.minimal_prompt(F.col("title"), F.col("path"), F.col("text"), models.shrunk(F.col("blocks")), F.col("similar")))
    a = F.from_json(T.json_object(F.col("response")), "struct<status:string,steps:array<string>,notes:array<string>>")
    got = completer.complete(prompts).withColumn("a", a)
    return cut(got.select(
        "procedure_id", "doc_id", "sec_idx", F.col("title").alias("section_title"), F.col("path").alias("section_path"), "start_line", "end_line", F.coalesce("a.status", F.lit("partial")).alias("status"),
        F.coalesce("a.steps", F.expr(NONE)).alias("steps"), F.coalesce("a.notes", F.expr(NONE)).alias("notes"), F.filter(F.transform("blocks", lambda b: b.id), lambda x: x.isNotNull()).alias("evidence_chunk_ids"),
    ))


def _asked_steps(procs: DataFrame, agents: DataFrame, defs: DataFrame, completer: models.Completer) -> DataFrame:
    names = agents.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "agent"))), lambda x: x.agent).alias("names"))
    known = defs.where("rank <= 120").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term", "definition", "line_no"))), lambda x: F.struct(x.term.alias("term"), x.definition.alias("definition"), x.line_no.alias("line_no"))).alias("known"))
    p = procs.join(names, "doc_id", "left").join(known, "doc_id", "left").withColumn("stage", F.lit("steps"))
    empty = F.expr(NONE)
    p = p.withColumn("prompt", models.steps_prompt(F.col("title"), F.col("path"), F.col("text"), F.col("names"), models.shrunk(F.col("blocks")), F.col("known"), empty, empty, F.col("similar")))
    got = completer.complete(p).withColumn("answer", T.json_object(F.col("response")))
    status = F.coalesce(F.get_json_object("answer", "$.status"), F.lit("partial"))
    notes = F.coalesce(F.from_json(F.get_json_object("answer", "$.notes"), "array<string>"), empty)
    return cut(got.select("procedure_id", F.get_json_object("answer", "$.steps").alias("steps_json"), status.alias("status"), notes.alias("notes")))


def _grounded(steps: DataFrame, procs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Steps with their agents by the document's alias map."""
    s = steps.join(procs.select("procedure_id", "doc_id"), "procedure_id")
    return definitions.ground(s, aliases).withColumn("agent", F.col("grounded")).drop("grounded", "doc_id")


def with_branches(steps: DataFrame, links: DataFrame) -> DataFrame:
    """``procedure_id, step_idx, step``: each step with its branches in order."""
    b = links.groupBy("procedure_id", "step_idx").agg(F.sort_array(F.collect_list(F.struct("branch_no", "label", "target"))).alias("bs"))
    w = Window.partitionBy("procedure_id").orderBy("step_idx")
    s = steps.where("id is not null and id <> ''").withColumn("step_idx", F.row_number().over(w) - 1).join(b, ["procedure_id", "step_idx"], "left")
    branches = F.transform(F.coalesce("bs", F.array().cast("array<struct<branch_no:int,label:string,target:string>>")), lambda x: F.struct(x.label.alias("label"), x.target.alias("target")))
    return s.select("procedure_id", "step_idx", F.struct("id", "type", "agent", "description_synthetic", "meta", branches.alias("branches")).alias("step"))


def points(steps: Column) -> Column:
    """One point a step, numbered from 1."""
    return F.transform(steps, lambda s, i: F.struct((i + 1).cast("string").alias("point_label"), s.description_synthetic.alias("original_text"), F.array(s).alias("steps")))


def _diagrams(procs: DataFrame, raw: DataFrame, steps: DataFrame, links: DataFrame) -> DataFrame:
    """Procedures as diagrams are drawn from: steps with branches, points, evidence, similar procedures."""
    listed = with_branches(steps, links).groupBy("procedure_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step_idx", "step"))), lambda x: x.step).alias("steps"))
    form = dict(listed.dtypes)["steps"]
    d = procs.join(raw.select("procedure_id", "status", "notes"), "procedure_id").join(listed, "procedure_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(form)))
    of = lambda kind: F.transform(F.filter("blocks", lambda b: b.kind == kind), lambda b: b.id)
    return d.select(
        "procedure_id", "doc_id", F.col("title").alias("section_title"), F.col("title").alias("subsection_title"), F.col("path").alias("section_path"), "status", "notes", F.col("text").alias("original_text_full"),
        "steps", points(F.col("steps")).alias("points"), F.struct(of("definition").alias("definitions"), of("passage").alias("other_passages")).alias("supporting_evidence"), F.col("similar").alias("similar_crossdoc_procedures"),
    )


def _stats(docs: DataFrame, n_lines: DataFrame, out: dict[str, DataFrame]) -> DataFrame:
    per = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    parts = (("outline", "n_titles"), ("sections", "n_sections"), ("records", "n_procedures"), ("definitions", "n_definitions_raw"), ("normalized", "n_definitions_normalized"), ("aliases", "n_agent_aliases"))
    stats = docs.select("doc_id").join(n_lines, "doc_id", "left")
    for name, column in parts:
        stats = stats.join(per(out[name], column), "doc_id", "left")
    n_steps = out["steps"].join(out["records"].select("procedure_id", "doc_id"), "procedure_id").groupBy("doc_id").agg(F.count("*").alias("n_steps"))
    return stats.join(n_steps, "doc_id", "left").fillna(0)

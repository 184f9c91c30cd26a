"""Whole runs: pipelines with memory, result files, evaluation, diagrams."""

import json

import pytest
from pyspark.sql import functions as F

from scrivano.operators import context, extraction, lines, memory, models, outline
from scrivano.plans import diagrams, evaluate, pipeline
from scrivano.sources import files, readers
from scrivano.sources.readers import Config

DOC = "REGOLAMENTO DI PROVA\n\n1 Definizioni\nSUAP: sportello unico per le pratiche\nUTENTE: chi presenta la domanda\n\n2 Modalità operative\n- Il richiedente compila il modulo\n- Il SUAP verifica entro 30 giorni\n\n3 Documentazione\nPrima di tutto il SUAP deve controllare i requisiti."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, DOC), (1, "senza titoli, qui"), (2, DOC.replace("SUAP", "SUE")), (3, None), (4, " ")], "doc_id long, text string").withColumn("title", F.lit("clash"))


@pytest.fixture(scope="module")
def rag(docs):
    return pipeline.run(docs, "rag", config=Config(freeze_global_patterns=False))


def test_retrieval_reaches_the_prompts(spark, docs, rag):
    seen = {}

    class Spy(models.Completer):
        def complete(self, prompts):
            seen.setdefault(prompts.select("stage").first()["stage"] if prompts.take(1) else "", prompts.select("prompt"))
            return pipeline.rules().complete(prompts)

    texts = {}
    for variant in ("rag", "guided"):
        seen.clear()
        pipeline.run(docs, variant, Spy(), patterns=rag["new_patterns"], procedures=rag["new_procedures"])
        texts[variant] = {k: " ".join(r.prompt for r in p.collect()) for k, p in seen.items() if k}
    assert "title_pattern :: " in texts["rag"]["titles"] and "title_pattern :: " not in texts["guided"]["titles"]
    assert "procedural_section_pattern ::" in texts["rag"]["section"] and "procedural_section_pattern ::" not in texts["guided"]["section"]
    for stage in ("minimal", "steps"):
        assert "doc_0_passage_" in texts["rag"][stage] and "_passage_" not in texts["guided"][stage]
        assert "global_proc_" in texts["rag"][stage] and "global_proc_" not in texts["guided"][stage]
    assert '["SUAP"' in texts["rag"]["steps"] or '"SUAP"' in texts["rag"]["steps"]


def test_context_leaves_the_section_out(rag):
    own = {(r.section_id): (r.start_line, r.end_line) for r in rag["flags"].collect()}
    for r in rag["context"].collect():
        assert r.kind in ("passage", "definition") and len(r.text) <= 900
    sec = next(k for k, v in own.items() if v == (6, 9))
    ids = {r.id for r in rag["context"].where(F.col("section_id") == sec).collect()}
    assert any("_def_" in i for i in ids) and not any(i.endswith("_passage_2") for i in ids)  # passage 2 is the section itself
    assert max(r.n for r in rag["context"].groupBy("section_id").agg(F.count("*").alias("n")).collect()) <= 12


def test_memory_flags(docs, rag):
    assert rag["new_patterns"].count() > 0 and rag["new_procedures"].count() == rag["records"].count()
    for variant, config, evaluation in (("rag", Config(), False), ("rag", Config(freeze_global_patterns=False, use_crossdoc_patterns=False), False), ("rag", Config(freeze_global_patterns=False), True), ("guided", Config(freeze_global_patterns=False), False)):
        out = pipeline.run(docs.limit(1), variant, config=config, evaluation=evaluation)
        assert out["new_patterns"].count() == 0 == out["new_procedures"].count()


def test_similar_procedures_are_of_other_documents(rag):
    secs = rag["flags"].where("is_procedure")
    got = memory.similar_procedures(secs, rag["new_procedures"]).join(secs.select("section_id", "doc_id"), "section_id").select("doc_id", F.explode("similar").alias("p")).collect()
    assert got and all(r.p.source_doc != r.doc_id and r.p.score is None for r in got)


def test_banks_grow_once(rag, tmp_path):
    p = str(tmp_path / "bank")
    assert memory.add_patterns(rag["new_patterns"], p) == rag["new_patterns"].count() and memory.add_patterns(rag["new_patterns"], p) == 0
    q = str(tmp_path / "procs")
    assert memory.add_procedures(rag["new_procedures"], q) == rag["new_procedures"].count() and memory.add_procedures(rag["new_procedures"], q) == 0


def test_definitions(spark, rag):
    d = {(r.doc_id, r.term): r for r in rag["definitions"].collect()}
    assert d["0", "SUAP"].definition == "sportello unico per le pratiche" and d["0", "SUAP"].line_no == 3 and d["0", "SUAP"].section_id
    n = {(r.doc_id, r.term): r for r in rag["normalized"].collect()}
    assert n["0", "SUAP"].section_title == "REGOLAMENTO DI PROVA" and n["0", "SUAP"].aliases == ["SUAP"] and n["0", "SUAP"].is_agent and n["0", "SUAP"].canonical_agent == "sportello unico per le pratiche"
    t = spark.createDataFrame([("0", "suap "), ("0", "altro"), ("0", " "), ("9", "SUAP")], "doc_id string, term string")
    got = {(r.doc_id, r.term): r.definition for r in extraction.match_definition(t, rag["definitions"]).collect()}
    assert got == {("0", "suap "): "sportello unico per le pratiche", ("0", "altro"): None, ("0", " "): None, ("9", "SUAP"): None}


def test_answers_that_are_no_definitions(spark, docs):
    answer = {"definitions": [{"term": "OGGETTO", "definition": "un titolo di sezione", "line_no": 3}, {"term": "ENTE", "definition": "chi decide su tutto", "line_no": "4"}, {"term": "ENTE", "definition": "breve ma valida", "line_no": 4}, {"term": "X", "definition": "troppo corto il termine", "line_no": 4}, {"term": "ASL", "definition": "azienda sanitaria", "line_no": "x"}, {"term": None, "definition": None, "line_no": None}]}

    class Fixed(models.Completer):
        def complete(self, prompts):
            return prompts.withColumn("response", F.lit("Ecco:\n" + json.dumps(answer)))

    lns = lines.lines(lines.documents(docs.limit(1)))
    secs = spark.createDataFrame([("0", 0, 0, 11, "T", "T", "s1")], "doc_id string, sec_idx int, start_line int, end_line int, title string, path string, section_id string")
    got = extraction.extract(lns, secs, Fixed(), "guided").collect()
    assert [(r.term, r.definition, r.line_no, r.section_id) for r in got] == [("ENTE", "chi decide su tutto", 4, "s1")]


def test_normalize_by_answer(spark):
    d = spark.createDataFrame([("0", 1, "Ufficio", "chi riceve le domande", 3, None, 1), ("0", 2, "UFFICIO", "altro", 4, None, 2), ("0", 3, "Z", "fuori", 5, None, 61)], "doc_id string, def_id long, term string, definition string, line_no int, section_id string, rank int")

    class Fixed(models.Completer):
        def complete(self, prompts):
            return prompts.withColumn("response", F.lit('{"normalized":" ufficio che riceve ","is_agent":true,"canonical_agent":"Ufficio","aliases":["a","a"," ","b"]}'))

    got = extraction.normalize_by_answer(d, Fixed()).collect()
    assert [(r.term, r.normalized, r.is_agent, r.canonical_agent, r.aliases) for r in got] == [("Ufficio", "ufficio che riceve", True, "Ufficio", ["Ufficio", "a", "b"])]


def test_files_round_trip_and_evaluation(spark, docs, rag, tmp_path):
    root = str(tmp_path / "out")
    for variant, out in (("rag", rag), ("only", pipeline.run(docs, "only"))):
        rows = files.write_files(files.document_files(out, variant), root).collect()
        assert all(r.error is None and r.size > 0 for r in rows)
        assert {r.path.split("/")[0] for r in rows} == {f"{i}{files.SUFFIX[variant]}" for i in (0, 1, 2)}
    text = (tmp_path / "out" / "0" / "0.rag.result.json").read_text(encoding="utf-8")
    one = json.loads(text)
    assert "Modalità" in text and one["doc_id"] == "0" and [t["title"] for t in one["outline"]][0] == "REGOLAMENTO DI PROVA" and one["stats"]["n_procedures"] == len(one["procedures"]) == len(one["diagram_procedures"])
    assert json.loads((tmp_path / "out" / "0_NO_RAG_ONLY" / "0_NO_RAG_ONLY.chunks.json").read_text())[0]["start_char"] == 0
    (tmp_path / "out" / "2" / "2.rag.result.json").write_text("[1]")  # no object: as if it were missing
    assert [r.doc for r in files.evaluated_documents(spark, root).collect()] == ["0", "1", "2"]
    gold = {
        "titles": spark.createDataFrame([("0", 0, "Regolamento di prova"), ("0", 1, "Definizioni"), ("0", 2, "Sanzioni")], "doc string, idx int, text string"),
        "procedures": spark.createDataFrame([("0", 0, "2 Modalità operative - Il richiedente compila il modulo - Il SUAP verifica entro 30 giorni")], "doc string, idx int, text string"),
        "agents": spark.createDataFrame([("0", 1, "operatore"), ("0", 1, "operatori"), ("0", 2, "sindaco")], "doc string, group_id int, alias string"),
    }
    m = evaluate.run(spark, root, gold)
    got = {(r.doc, r.kind, r["first"], r.second, r.block): r for r in m.collect()}
    t = got["0", "gold_vs", "gold", "rag", "titles"]
    assert (t.tp, t.fn) == (2, 1) and t.recall == pytest.approx(2 / 3)
    p = got["0", "gold_vs", "gold", "rag", "procedures"]
    assert p.tp == 1
    a = got["0", "gold_vs", "gold", "rag", "agents"]
    assert (a.tp, a.fp, a.fn) == (1, 0, 1)
    assert got["0", "pairwise", "rag", "no_rag_only", "titles"].f1 == 1.0 and ("2", "pairwise", "rag", "no_rag_only", "titles") not in got
    s = json.loads((tmp_path / "out" / "evaluation_summary.json").read_text())
    assert s["thresholds"]["titles"] == 0.85 and any(x["metric"] == "f1" and x["kind"] == "pairwise" and x["block"] == "titles" for x in s["aggregate"])


def test_agents_by_procedure(spark):
    gold = spark.createDataFrame([("d", 0, "compilare il modulo e inviare la domanda"), ("d", 1, "verificare i requisiti del richiedente"), ("e", 0, "altro testo qui")], "doc string, idx int, text string")
    ga = spark.createDataFrame([("d", 0, "richiedente"), ("d", 1, "suap"), ("d", 1, "comune"), ("e", 5, "x")], "doc string, proc_idx int, agent string")
    pred = spark.createDataFrame([("d", "rag", 0, "verificare i requisiti del richiedente"), ("d", "rag", 1, "compilare il modulo e inviare la domanda"), ("e", "rag", 0, "altro testo qui")], "doc string, system string, idx int, text string")
    pa = spark.createDataFrame([("d", "rag", 0, "suap"), ("d", "rag", 1, "richiedente"), ("d", "rag", 1, "suap")], "doc string, system string, idx int, agent string")
    got = [tuple(r) for r in evaluate.agents_by_procedure(gold, ga, pred, pa).collect()]
    assert got == [("d", "rag", 2, 0.75, 0.75, pytest.approx(2 / 3))]


def test_diagram_run(spark, rag, tmp_path):
    d = rag["diagrams"]
    layouts = diagrams.three_layouts(d)
    n = d.count()
    assert layouts.count() == 3 * n
    c = {(r.doc_id, r.layout): (r.ok, r.fail) for r in diagrams.counts(layouts).collect()}
    assert c["0", "bpmn"] == (2, 1)  # one procedure has no steps
    rows = diagrams.run(d, str(tmp_path)).collect()
    assert len(rows) == sum(ok for ok, _ in c.values()) and all(r.error is None for r in rows)
    assert "lane: Operatore" in (tmp_path / "0" / "bpmn" / "0_proc_002.piperflow.txt").read_text()
    assert (tmp_path / "0" / "strategy" / "0_proc_002.dot").read_text().startswith('digraph "2 Modalità operative"')
    # points stand in for missing steps
    p = d.where("procedure_id = '0_proc_002'").withColumn("steps", F.slice("steps", 1, 0))
    assert diagrams.collected_steps(p).count() == 2
    q = spark.createDataFrame([('a"b\\c\'d',)], "x string").select(diagrams.literal(F.col("x")).alias("y")).first().y
    assert eval(f'"{q}"') == 'a"b\\c\'d'


def test_write_files_reports_errors(spark, tmp_path):
    df = spark.createDataFrame([("a/x.json", '{"è": 1}'), ("a/y.json", "no json"), (None, "{}"), ("z.json", None), ("t.txt", "così")], "path string, content string")
    got = {r.path: r.error for r in files.write_files(df, f"file://{tmp_path}").collect()}
    assert got["a/x.json"] is None and "Error" in got["a/y.json"] and set(got) == {"a/x.json", "a/y.json", "t.txt"}
    assert (tmp_path / "a" / "x.json").read_text(encoding="utf-8") == '{\n  "è": 1\n}'

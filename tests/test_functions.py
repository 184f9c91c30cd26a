"""Golden values of scalar functions and scores."""

import pytest
from pyspark.sql import functions as F

from scrivano.functions import scores as S
from scrivano.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "line,score",
    [
        ("Procedure:", 0.81), ("Competenze.", 0.63), ("STATO DELL’ARTE E CRITICITA’", 0.46), ("1 Oggetto", 0.55), ("1.2 Ambito di applicazione", 0.55), ("1. Gli Operatori notificano", 0.0),
        ("Art. 5 Sanzioni", 0.63), ("La domanda deve essere presentata", 0.13), ("testo minuscolo breve", 0.10), ("Servizi Veterinari, ASL", 0.0), ("Requisiti è", 0.48), ("", 0.0), (None, 0.0),
    ],
)
def test_title_score(spark, line, score):
    assert one(spark, line, S.title_score) == pytest.approx(score, abs=1e-9)


@pytest.mark.parametrize(
    "text,rag,guided,only",
    [
        ("Procedure:\n- compilare il modulo\n- inviare la PEC", 0.20, 0.0, 0.30), ("- compilare il modulo", 0.50, 0.30, 0.30),
        ("La domanda va presentata entro 30 giorni", 0.40, 0.40, 0.40), ("Verificare i dati", 0.20, 0.0, 0.0),
    ],
)
def test_procedural_score(spark, text, rag, guided, only):
    for v, want in (("rag", rag), ("guided", guided), ("only", only)):
        assert one(spark, text, lambda c, v=v: S.procedural_score(c, v)) == pytest.approx(want)


def test_title_hint(spark):
    for t in ("Modalità operative", "Istruzioni", "Iter autorizzativo", "Compiti"):
        assert one(spark, t, S.title_hint)
    for t in ("Procedura", "Attività", "Verifiche"):
        assert not one(spark, t, S.title_hint)
        assert one(spark, t, lambda c: S.title_hint(c, stem=True))


@pytest.mark.parametrize("args,want", [((50, 18, 50), (50, 50, 38, 30, 22)), ((180, 80, 180), (180, 180, 135, 108, 81)), ((6, 3, 6), (6, 6, 4, 4, 3)), ((16, 8, 16), (16, 16, 12, 10, 8)), ((4, 2, 4), (4, 4, 3, 2, 2)), ((8, 4, 8), (8, 8, 6, 5, 4))])
def test_adaptive_k(spark, args, want):
    df = spark.createDataFrame([(n,) for n in (0, 1999, 2000, 4000, 8000)], "n int")
    assert tuple(r[0] for r in df.select(T.adaptive_k(F.col("n"), *args)).collect()) == want


@pytest.mark.parametrize(
    "prefix,parts,want",
    [
        ("line", ("doc1", "0"), "line_bae9a49ab678581a"), ("sec", ("doc1", "0", "9", "Procedure"), "sec_1171c8dc616f6b30"), ("passage", ("doc1", "0", "2", "0"), "passage_2a8ac26c0d981866"),
        ("def", ("doc1", "0", "SUAP"), "def_1f2ad92a00e66fa8"), ("global_proc", ("doc1", "0", "T", "T"), "global_proc_d52f92aa3967db98"),
    ],
)
def test_stable_id(spark, prefix, parts, want):
    assert spark.range(1).select(T.stable_id(prefix, *map(F.lit, parts))).first()[0] == want


def test_shapes_and_agents(spark):
    assert one(spark, "1 Oggetto del BANDO", T.title_pattern).endswith("<NUM> <CAP> <LOW> <ALLCAPS>")
    assert one(spark, "Art. 5 Sanzioni", T.title_pattern).endswith("<LOW> <NUM> <CAP>")
    for a, b in (("A.S.L.", "asl"), ("S.U.A.P.", "suap"), ("c.c.i.a.a. di Roma", "cciaa di roma"), ("P.Z.", "p z")):
        assert one(spark, a, T.normalize_agent) == b
    for a, b in ((None, "Operatore"), (" ", "Operatore"), ("clerk", "Operatore"), ("Utente", "Richiedente"), ("ufficio suap", "Ufficio suap")):
        assert one(spark, a, T.agent_name) == b


def test_text(spark):
    assert one(spark, "a\r\nb  \rc", T.normalize_text) == "a\nb\nc"
    assert one(spark, "x" * 10, lambda c: T.truncate(c, 10)) == "x" * 10
    assert one(spark, "abcd\nefghij", lambda c: T.truncate(c, 6)).startswith("abcd")
    assert one(spark, "uno due tre quattro", lambda c: T.wrap(c, 8)) == "uno due\\ntre\\nquattro"
    assert one(spark, 'ok {"a": 1} x', T.json_object) == '{"a": 1}'
    assert one(spark, "[1]", T.json_object) == "{}"
    assert one(spark, "Sì", T.yes_no) == "SI"
    assert one(spark, "x", T.store_name).startswith("col_")
    assert one(spark, "a [b] <c>|d", T.dsl_safe) == "a b c d"
    assert one(spark, "Sportello Unico", lambda c: T.agent_queries(c)) == ["Sportello Unico", "sportello unico", "sportello", "unico"]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', '{"a": 1}'), ('Ecco: {"a": "x } y", "b": {"c": [1]}} fine {"d": 2}', '{"a": "x } y", "b": {"c": [1]}}'), ("{non json} {\"a\": 2}", '{"a": 2}'), ("[1, {\"a\": 2}]", "{}"), ('"solo testo {}"', "{}"),
        ("", "{}"), (None, "{}"), ("{" * 3000, "{}"), ('```json\n{"a": "{"}\n```', '{"a": "{"}'),
    ],
)
def test_first_json(text, want):
    assert T.first_json(text) == want


def _acronyms(s):
    """Every dotted acronym of three letters or more loses its full stops."""
    import re

    for m in re.findall(r"(?i)\b(?:[a-z]\.\s*){2,}[a-z]\.?(?!\w)", s):
        s = s.replace(m, re.sub("[^a-zA-Z]", "", m).lower())
    return s


def test_normalize_agent_against_brute_force(spark, data):
    import re

    rows = spark.read.parquet(f"{data}/prompt_blocks.parquet").select(F.explode("allowed_agents").alias("a")).where("a is not null").distinct().select("a", T.normalize_agent(F.col("a")).alias("n")).collect()
    extra = ["S.U.A.P. di Roma", "c.c.i.a.a.", "A. S. L. 2", "P.Z.", "s.r.l.", "", "  ", "Uff.\tTecnico"]
    rows += spark.createDataFrame([(x,) for x in extra], "a string").select("a", T.normalize_agent(F.col("a")).alias("n")).collect()
    assert len(rows) > 50
    for r in rows:
        want = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", _acronyms(re.sub(r"[ \u00a0\t]+", " ", r.a).strip().lower()))).strip()
        assert r.n == want, r.a

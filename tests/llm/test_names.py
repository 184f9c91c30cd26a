"""Name parsing and comparison, and the linking of names in documents."""

import random

import pytest
from pyspark.sql import functions as F

from scrivano.llm import canonical, fusion, metric, names, variants
from scrivano.llm.components import components

SAME = [
    ("Settore Tutela Acque Minori", "Setore Tutela Acque Minnori"), ("Settore Tutela Acque Minori", "sett. tute. acque min."), ("Settore Tutela Acque Minori", "STAM"), ("Settore Tutela Acque Minori", "S.T.A.M."),
    ("Settore Tutela Acque Minori", "Settore STAM"), ("Settore Tutela Acque Minori", "Acque Minori - Settore Tutela"), ("Settore Tutela Acque Minori", "Tutela Acque Minori (Settore)"), ("Settore Tutela Acque Minori", "Il settore per la tutela di acque minori"),
    ("Settore Tutela Acque Minori", "Settore TutelaAcque Minori"), ("Settore Tutela Acque Minori", "Settore Tutela Acque Minori dell'Ente"), ("Richiedente", "il richiedente (art. 2)"), ("Anna Bardoni", "dott. A. Bardoni"), ("Anna Bardoni", "BARDONI, Anna"),
    ("Consorzio Irriguo Fertandro", "Consorzio Irriguo Fertandro S.r.l."), ("Consorzio Irriguo Fertandro di Dulsorno", "Consorzio Fertandro"), ("Adalgisa Bardoni", "Gisa Bardoni"), ("Gualtiero Perzoni", "dott. Perzoni"),
]
OTHER = [
    ("Settore Tutela Acque Minori", "Settore Tutela Boschi Minori"), ("Settore Tutela Acque Minori", "Centro Tutela Acque Minori"), ("Anna Bardoni", "Luigi Bardoni"), ("Canone ordinario", "Canone interno"), ("n.d.", "n.d."),
    ("Settore Tutela Acque Minori", "STAV"), ("Richiedente", ""), ("Richiedente", None),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert names.compare(names.parse(a), names.parse(b)).same
    assert names.compare(names.parse(b), names.parse(a)).same


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not names.compare(names.parse(a), names.parse(b)).same


def test_form_round_trip():
    for a, _ in SAME:
        assert names.form(names.unform(names.form(names.parse(a)))) == names.form(names.parse(a))


def test_metric_pairs_lose_nothing(spark):
    rnd = random.Random(5)
    pts = [(f"d{d}", "".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 9))), f"f{i}") for d in range(2) for i in range(150)]
    df = spark.createDataFrame(pts, "doc_id string, key string, form string")
    split = {tuple(r) for r in variants.metric_pairs(df, 2, cell=10).collect()}
    whole = {tuple(r) for r in variants.metric_pairs(df, 2, cell=10_000).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(out[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = out
        return row[-1]

    brute = {(d, min(f, g), max(f, g)) for d, k, f in pts for e, m, g in pts if d == e and f < g and lev(k, m) <= 2}
    assert split == whole == brute


def test_components(spark):
    e = [("d", f"n{i}", f"n{i + 1}") for i in range(9)] + [("d", "x", "y"), ("e", "n0", "x"), ("d", "q", "q"), ("d", None, "z")]
    got = {(r.doc_id, r.node): r.label for r in components(spark.createDataFrame(e, "doc_id string, a string, b string")).collect()}
    assert all(got["d", f"n{i}"] == "n0" for i in range(10)) and got["d", "y"] == "x" and got["e", "x"] == "n0" and len(got) == 14
    assert components(spark.createDataFrame([], "doc_id string, a string, b string")).count() == 0


def test_link_names(spark):
    rows = [("1", a) for p in SAME[:6] for a in p] + [("1", "Centro Tutela Acque Minori"), ("2", "STAM"), ("1", None), ("1", "  "), (None, "x"), ("1", "n.d."), ("1", "altri"), ("1", "y" * 5000)]
    df = spark.createDataFrame(rows + rows, "doc_id string, name string").withColumn("entity", F.lit("clash")).withColumn("form", F.lit(1))
    linked = variants.link_names(df)
    pairs = {tuple(r) for r in variants.variant_pairs(linked).collect()}
    group = {a for p in SAME[:6] for a in p}
    assert pairs == {("1", a, b) for a in group for b in group if a < b}
    assert linked.count() == len({(d, n) for d, n in rows if d and n and n.strip()})
    assert variants.link_names(df.limit(0)).count() == 0


def test_candidates_reach_every_accepted_pair(spark):
    rows = ["Consorzio Irriguo Oltrabindro di Versoglia", "Consorzio Irrgiuo Olrabindro", "Circolo Apestico Lerveezzo", "Circolo Lervezzo", "T. Orvisimbri", "Orviisimbri Tolomeo", "dott. Gazzarmbri", "Gazzambri Eustachio", "l. s. Oltradevra", "Lateria Sociale Oltradevra Quarponte", "Settore Tutela Acque Minori", "S.T.A.M.", "Min. Acq. Tut.", "Tutela Acque Minori", "SetoreTutela Acque Minori", "Via Po Est", "Est Po Via", "x" * 31 + " aba", "aba " + "x" * 29]
    rnd = random.Random(3)
    long = "abcdefghilmnopqrstuvzabcdefghilm"
    for base in ("Latteria Sociale Crodessa Urbbilla", "Eustachio Quellietti", f"Ente {long}"):
        for _ in range(12):
            ws = [w if rnd.random() < 0.4 else w[:k] + w[k + 1] + w[k] + w[k + 2 :] if rnd.random() < 0.5 else w[:k] + w[k + 1 :] for w in base.split() for k in [rnd.randrange(len(w) - 1)]]
            rnd.shuffle(ws)
            rows.append(" ".join(ws[: rnd.choice([2, 3, 4])]))
    parsed = {names.form(n): n for n in map(names.parse, rows)}
    forms = [("d", f, [f"{a}:{b}" for a, b in names.keys(n) if a != "word"], names.slips(n)) for f, n in parsed.items()]
    df = spark.createDataFrame(forms, "doc_id string, form string, pts array<string>, slips array<struct<g:int,w:string>>")
    accepted = {("d", a, b) for a in parsed for b in parsed if a < b and names.compare(parsed[a], parsed[b]).same}
    assert ("d", "circolo apestico lerveezzo", "circolo lervezzo") in accepted and len(accepted) > 50
    for cell in (10_000, 5):
        assert accepted <= {tuple(r) for r in variants.candidates(df, cell=cell).collect()}


def test_link_names_dropped_word_with_slips(spark):
    rows = ["Consorzio Irriguo Oltrabindro di Versoglia", "Consorzio Irrgiuo Olrabindro"]
    other = [["T. Orvisimbri", "Orviisimbri Tolomeo"], ["Circolo Apestico Lerveezzo", "Circolo Lervezzo"]]
    docs = [rows, *other]
    df = spark.createDataFrame([(str(i), a) for i, d in enumerate(docs) for a in d], "doc_id string, name string")
    assert {tuple(r) for r in variants.variant_pairs(variants.link_names(df)).collect()} == {(str(i), *sorted(d)) for i, d in enumerate(docs)}


def test_canonical(spark):
    reg = spark.createDataFrame([(1, "Settore Tutela Acque Minori", None), (2, "Centro Collaudi Orti Urbani", "CCOU"), (3, "Richiedente", None), (4, None, "X"), (3, "Richiedente", None)], "id long, name string, acronym string")
    vals = [("Setore Tutela Acque Minori", 1), ("stam", 1), ("ccou", 2), ("Orti Urbani - Centro Collaudi", 2), ("il richiedente", 3), ("Richiedente", 3), ("Settore Tutela Boschi Minori", None), ("???", None), ("", None), ("z" * 3000, None)]
    df = spark.createDataFrame([(v,) for v, _ in vals * 2] + [(None,)], "value string").withColumn("id", F.lit(9)).withColumn("grams", F.lit("clash"))
    got = {r["value"]: r["id"] for r in canonical.map_values(df, reg.withColumn("value", F.lit("clash"))).collect()}
    assert got == dict(vals)
    assert {r["id"] for r in canonical.map_values(df, reg.limit(0)).collect()} == {None}
    assert canonical.map_values(df.limit(0), reg).count() == 0


SCHEMA = "def_id long, doc_id string, term string, definition string, line_no int, section_id string, variant string, extracted_at timestamp, loaded_at timestamp"


def test_representatives(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    good = "Indica il funzionario competente per la zona di valle, visto il parere."
    rows = [
        (1, "7", "Canone ordinario", good, 1, None, "rag", t(1), t(1)), (2, "7", "CANONE ORDINARIO", good + " ", 0, None, "no_rag_only", t(5), t(5)), (3, "7", "Canone  ordinario", good[:40], 9, None, "gold", t(6), t(6)),
        (4, "7", "«Canone ordinario»", good + " " + good, -1, None, "rag", t(7), t(7)), (5, "7", "Canone ordinario", good + " Pag. 38", None, None, None, t(8), t(8)), (6, "7", "Canone ordinario", None, 2, None, "rag", None, t(9)),
        (7, "7", None, good, 1, None, "rag", t(1), t(1)), (8, "7", " ", good, 1, None, "rag", t(1), t(1)), (9, "7", "Lotto", good, 1, None, "rag", t(1), t(1)),
        (10, "8", "Lotto", "n.d.", 5, None, "x", t(1), t(1)), (11, "8", "lotto", None, None, None, "y", t(1), t(1)),
    ]
    raw = spark.createDataFrame(rows + rows, SCHEMA).withColumn("entity", F.lit(0)).withColumn("p", F.lit(0)).withColumn("lines", F.lit(0))
    docs = spark.createDataFrame([(7, "a\nb\nc"), (8, None)], "doc_id long, text string")
    ext = spark.createDataFrame([("gold", 0), ("rag", 1), ("no_rag_only", 3)], "variant string, trust_rank int")
    got = {r.first_def_id: (r.term_def_id, r.definition_def_id, r.line_def_id, r.records) for r in fusion.representatives(raw, docs, ext).collect()}
    assert got == {1: (3, 2, 2, 6), 10: (11, -1, -1, 2)}
    assert fusion.representatives(raw.limit(0), docs, ext).count() == 0
    assert fusion.representatives(raw, docs.limit(0), ext.limit(0)).where("line_def_id <> -1").count() == 0


def claims_of(spark, rows):
    """Rows (group, definition, source) as the claims that ``fuse`` takes."""
    df = spark.createDataFrame([(i, g, "e", d, v, 0) for i, (g, d, v) in enumerate(rows)], "def_id long, doc_id string, entity string, definition string, variant string, trust int")
    df = fusion.prepare(df).withColumn("late", F.struct(F.lit(None).cast("timestamp").alias("at"), "def_id")).withColumn("line_ok", F.lit(True))
    return fusion.by_claim(df)


def test_copying_is_discounted(spark):
    """Two sources that share false values count for little more than one."""
    rows = []
    for g in range(40):
        true, false = f"Valore giusto che porta il numero {g}.", f"Valore sbagliato che porta il numero {g}"
        rows += [(str(g), false, "copy1"), (str(g), false, "copy2"), (str(g), true, "good")]
    post, m = fusion.fuse(fusion.continued_gathered(claims_of(spark, rows)))
    got = post.where("p > 0.5").select("s").distinct().collect()
    assert [r.s for r in got] == [["good"]]
    assert m.accuracy["good"] > 0.9 > 0.2 > m.accuracy["copy1"] and m.dependence["copy1", "copy2"] > 0.9
    assert fusion.vote_of(["a", "b"], {"a": 0.8, "b": 0.8}, {("a", "b"): 1.0, ("b", "a"): 1.0}) < 0.7 * fusion.vote_of(["a", "b"], {"a": 0.8, "b": 0.8}, {})


def test_independent_sources_overrule_the_form(spark):
    """What four independent sources say is whole although it has no full stop; from one source, or two that copy, it isn't."""
    rows = [(str(g), f"Indica la zona di competenza numero {g}.", s) for g in range(200) for s in ("a", "b", "c", "d")]
    rows += [(str(g), f"Indica la zona {g} e poi", s) for g, s in zip(range(200), "abcd" * 50)]
    odd = "Indica la zona senza punto finale"
    rows += [("x", odd, s) for s in "abcd"] + [("y", odd, "a")]
    post, m = fusion.fuse(fusion.continued_gathered(claims_of(spark, rows)))
    p = {r.doc_id: r.p for r in post.where(F.col("doc_id").isin("x", "y")).collect()}
    assert p["x"] > 0.9 and p["y"] < 0.1


def test_cut_at_a_sentence_end(spark):
    """A beginning, however short, that another claim carries on; both ways of grouping find it."""
    rows = [("1", "Vale fino a sera.", "a"), ("1", "Vale fino a sera. Poi il termine decade.", "b"), ("2", "Vale fino a sera.", "a"), ("3", "Vale fino a sera. Poi il", "b"), ("3", "Vale fino a sera.", "b"), ("4", None, "a"), ("4", " ", "b")]
    c = claims_of(spark, rows)
    one, two = ({(r.doc_id, r.v, r.continued) for r in f(c).select("doc_id", "v", "continued").collect()} for f in (fusion.continued_gathered, fusion.continued_tables))
    assert one == two and [d for d, _, k in one if k] == ["1"] and ("4", None, False) in one
    assert fusion.claim_of("x " * 100_000)[0] != fusion.claim_of("x " * 99_999)[0]


def test_large_documents_are_fused_alike(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    args = t("definitions_raw"), t("documents"), t("extractors")
    a, b = fusion.chosen(*args).drop("posterior"), fusion.chosen(*args, gather=2).drop("posterior")
    assert a.count() > 0 and sorted(a.collect()) == sorted(b.collect())


def test_large_documents_are_linked_alike(spark):
    rows = [(str(k % 3), a) for k, p in enumerate(SAME + OTHER) for a in p if a]
    rows += [("9", f"{a} {b}") for a in ("Canone", "Registro", "Lotto", "Marca") for b in ("ordinario", "ordinaria", "interno", "colettivo", "collettivo", "frazionato")] * 2
    df = spark.createDataFrame(rows, "doc_id string, name string")
    assert sorted(variants.link_names(df).collect(), key=str) == sorted(variants.link_names(df, cell=5, gather=1).collect(), key=str)


def test_radius_join(spark):
    rnd = random.Random(2)
    keys = sorted({"".join(rnd.choice("abcdè") for _ in range(rnd.randint(1, 9))) for _ in range(250)})
    brute = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if metric.levenshtein(keys[i], keys[j], 9) <= 2}
    for cell in (5, 1000):
        got = list(metric.radius_join(keys, 2, cell))
        assert set(got) == brute and len(got) == len(brute)


def test_canonical_judges_what_shares_common_features_only(spark):
    """One slip agrees by half, so a cosine of 0.3 is accepted; here all shared features are common ones."""
    reg = spark.createDataFrame([(0, "Amministratore", None)] + [(i, f"Amministratore {chr(96 + i % 26 + 1)}{'aeiou'[i % 5]}rz{'aeiou'[i % 3]}", None) for i in range(1, 48)], "id long, name string, acronym string")
    df = spark.createDataFrame([("Amministrtore",)], "value string")
    assert [r.id for r in canonical.map_values(df, reg).collect()] == [0]


def test_canonical_in_blocks_and_by_brute_force(spark, data):
    """Blocks of the list give what the whole list gives, and the index what scoring all entries gives."""
    reg = spark.read.parquet(f"{data}/agent_registry.parquet").selectExpr("cast(agent_id as long) id", "canonical_agent name", "acronym")
    rows = canonical.typed_agents(spark.read.parquet(f"{data}/definitions_normalized.parquet"), spark.read.parquet(f"{data}/prompt_blocks.parquet"))
    one, two = (sorted(canonical.map_values(rows.select("value"), reg, block=b).withColumn("score", F.round("score", 9)).collect(), key=str) for b in (20_000, 40))
    assert one == two and sum(r.id is not None for r in one) > 100
    entries = [(r.id, names.parse(r.name), r.acronym) for r in reg.collect()]
    feats = {i: set(canonical.grams(n)) | ({"#" + a.lower()} if a else set()) for i, n, a in entries}
    df = {g: sum(g in f for f in feats.values()) for f in feats.values() for g in f}
    import math

    w = lambda g: math.log(1 + len(entries) / df[g] if g in df else 1 + len(entries)) * (2 if g[0] == "#" else 1)
    norm = lambda gs: math.sqrt(sum(w(g) ** 2 for g in gs)) or 1.0
    literal = {r.name for r in reg.collect()}
    for r in one:
        if r.id is not None and r.value not in literal:
            gs = set(canonical.grams(names.parse(r.value)))
            cos = {i: sum(w(g) ** 2 for g in gs & f) / (norm(gs) * norm(f)) for i, f in feats.items()}
            assert abs(cos[r.id] - r.score) < 1e-6 and r.score >= canonical.THRESHOLD

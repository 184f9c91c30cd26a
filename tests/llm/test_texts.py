"""Scans, segmentation, leakage, mixing and repetition."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivano.llm import leakage, mixing, repetition, scans, segment, topics
from scrivano.llm import tokens as K


# ---- segmentation --------------------------------------------------------------------------------------------------


def rebuilt(text, spans, overlap):
    out = text[spans[0][0] : spans[0][1]]
    for s, e in spans[1:]:
        out += text[s + overlap : e]
    return out


def test_split_text_gives_text_back():
    rnd = random.Random(6)
    for _ in range(60):
        t = "".join(rnd.choice(["parola ", "altra ", "fine. ", "punto; ", "\n\n", "\n- voce ", "x" * rnd.randint(1, 300)]) for _ in range(rnd.randint(1, 400)))
        spans, whole = segment.split_text(t)
        assert all(0 < e - s <= 1200 for s, e in spans) and spans[0][0] == 0 and spans[-1][1] == len(t)
        assert all(b[0] == a[1] - 100 for a, b in zip(spans, spans[1:])) and rebuilt(t, spans, 100) == t
        edges = [0, *segment.boundaries(t), len(t)]
        assert whole == all(len(t[a:b].strip()) <= 1200 for a, b in zip(edges, edges[1:]))


def test_cut_falls_into_the_valley():
    a, b = "Il bosco e il fiume portano acqua ai campi. ", "La banca presta denaro contro un pegno sicuro. "
    t = a * 18 + b * 16
    spans, whole = segment.split_text(t)
    assert whole and spans[0][1] in (len(a) * 18 - 1, len(a) * 18)


def test_depth_climbs_to_the_nearest_peak():
    sim = np.array([0.9, 0.5, 0.7, 0.2, 0.1, 0.3, 0.3, 0.8, 0.6])
    assert np.allclose(segment.climb(sim), [0.9, 0.9, 0.7, 0.7, 0.7, 0.3, 0.3, 0.8, 0.8])
    depth = (segment.climb(sim) - sim) + (segment.climb(sim[::-1])[::-1] - sim)
    assert depth.argmax() == 4 and depth[7] == 0  # a peak is no valley, a far higher peak does not count


def test_ends_of_pieces(spark):
    text = "Prima frase. " + "parola " * 160 + "fine. " + "altra " * 150 + "fine."
    df = spark.createDataFrame([("text", "a", text, None), ("evidence", "b", None, ["x_definition_1"] * 10 + ["x_passage_1"] * 10)], "src string, item_key string, text string, ids array<string>")
    got = segment.split_oversized(df).orderBy("src", "piece").collect()
    for r in got:
        edge = segment.boundaries(text) + [len(text)] if r.src == "text" else [10, 20]
        assert r.ends == ("natural" if r.end in edge else "forced")
    assert {(r.src, r.cut) for r in got} == {("text", "natural"), ("evidence", "natural")}


def test_split_ids():
    ids = [f"doc_1_definition_{i}" for i in range(8)] + [f"doc_1_passage_{i}" for i in range(9)]
    spans, whole = segment.split_ids(ids)
    assert whole and spans[0] == (0, 8) and spans[1][0] == 7
    assert not segment.split_ids([f"doc_1_passage_{i}" for i in range(13)])[1]


def test_split_oversized(spark):
    rows = [("text", "a", "x" * 1200, None), ("text", "b", "y" * 50_000, None), ("text", "c", None, None), ("text", "d", "", None), ("evidence", "e", None, ["p"] * 12), ("evidence", "f", None, [None] * 13), ("evidence", "g", None, None)]
    df = spark.createDataFrame(rows, "src string, item_key string, text string, ids array<string>").withColumn("cut", F.lit(1)).withColumn("piece", F.lit("clash"))
    got = segment.split_oversized(df)
    assert {(r.src, r.item_key, r.cut) for r in got.collect()} == {("text", "b", "forced"), ("evidence", "f", "forced")}
    assert segment.split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        segment.split_oversized(df, 100, 60)


# ---- repetition ----------------------------------------------------------------------------------------------------


def brute_repeated(ws, n=5):
    seen, marked = {}, [False] * len(ws)
    for i in range(len(ws) - n + 1):
        g = tuple(ws[i : i + n])
        if g in seen:
            marked[i : i + n] = [True] * n
        seen.setdefault(g, i)
    for p in range(1, n):
        i = p
        while i < len(ws):
            j = i
            while j < len(ws) and ws[j] == ws[j - p]:
                j += 1
            if j - i >= max(2 * p, 3):
                marked[i:j] = [True] * (j - i)
            i = max(j, i + 1)
    return sum(marked)


def test_repetition_against_brute_force(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += ["Ok, ok! OK 1 ok 2 ok", "", None, "uno due", "una frase di cinque parole. " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("llr", F.lit(0))
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    for i, t in enumerate(texts):
        ws = [w.casefold() for w in K.LETTERS.findall(t or "")]
        assert (got[i].words, got[i].repeated) == (len(ws), brute_repeated(ws))
        assert got[i].flagged == (len(ws) > 0 and 10 * got[i].repeated >= 4 * got[i].words)
    assert repetition.repetition(df.limit(0)).count() == 0


def test_ratio_decides_at_the_threshold(spark):
    """Ties at 40 %, whatever the trusted documents are like."""
    texts = ["a b c d e a b c d e f g h i j k l m n o p q r s t", "x y z v w x y z v w u", "q r s t u q r s t u q r s t u 1 2 3", " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(60)), "p q r s t p q r s t b1 c d", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for told in (None, F.col("doc_id") == 3, F.col("doc_id") == 2, F.lit(False), F.lit(None).cast("boolean")):
        got = {r.doc_id: r for r in repetition.repetition(df, told).collect()}
        assert all(r.flagged == (r.words > 0 and 10 * r.repeated >= 4 * r.words) for r in got.values())
    exact = [" ".join(["a b c d e"] * 2 + ["f g"] + [c for c in "hi"]) + " l"]  # 5 of 15 words; then 10 of 25
    exact.append(" ".join(["a b c d e"] * 3) + " " + " ".join("fghijklmno"))
    got = [r.flagged for r in repetition.repetition(spark.createDataFrame(list(enumerate(exact)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [False, True]


# ---- leakage -------------------------------------------------------------------------------------------------------

VOCAB = [f"parola{i}" for i in range(3000)]


def edit_distance_window(doc, item, least=20, rate=0.1):
    """Brute force: an item stretch of ``least`` words or a few more, its first and last word in place, against its
    best document stretch."""
    if len(set(doc) & set(item)) < least // 2:
        return False
    far = 10**6
    for a in range(len(item) - least + 1):
        row = [0 if y == item[a] else far for y in doc]
        for i, x in enumerate(item[a + 1 : a + least + 3], 2):
            new = [far] * len(doc)
            best = far
            for j, y in enumerate(doc):
                diag = row[j - 1] if j else far
                new[j] = min((new[j - 1] if j else far) + 1, row[j] + 1, diag + (x != y))
                if x == y:
                    best = min(best, diag)
            row = new
            if i >= least and best <= rate * i:
                return True
    return False


def test_align_neighbouring_edits():
    item = np.arange(35)
    pads = np.arange(900, 940)
    for mid in ([701, 702], [], [17, 801, 802, 18]):  # two words in a row changed, dropped, added
        doc = np.concatenate([pads, item[:17], np.array(mid, int), item[19:], pads])
        assert leakage.align(doc, item)
    assert not leakage.align(np.concatenate([item[:17], [701, 702, 703, 704, 705], item[22:]]), item)


def test_align_against_all_stretches():
    rnd = random.Random(11)

    def brute(doc, item):
        for i0 in range(len(item)):
            for j0 in range(len(doc)):
                if item[i0] != doc[j0] or (i0 and j0 and item[i0 - 1] == doc[j0 - 1]):
                    continue
                row = list(range(len(doc) - j0 + 1))
                for i in range(i0, len(item)):
                    out = [i - i0 + 1]
                    for j in range(j0, len(doc)):
                        k = j - j0
                        out.append(min(out[k] + 1, row[k + 1] + 1, row[k] + (item[i] != doc[j])))
                        if item[i] == doc[j] and i - i0 + 1 >= leakage.WINDOW and row[k] <= leakage.RATE * (i - i0 + 1):
                            return True
                    row = out
        return False

    seen = []
    for _ in range(60):
        item = [rnd.randrange(25) for _ in range(rnd.randint(22, 36))]
        doc = list(item)
        at = rnd.randrange(len(doc) - 4)
        for k in range(rnd.randint(2, 5)):
            x = min(max(at + k if rnd.random() < 0.6 else rnd.randrange(len(doc)), 0), len(doc) - 1)
            doc[x : x + rnd.randint(0, 1)] = rnd.choice([[], [rnd.randrange(25)]])
        seen.append((leakage.align(np.array(doc), np.array(item)), brute(doc, item)))
    assert all(a == b for a, b in seen) and {a for a, _ in seen} == {True, False}


def test_leakage_against_brute_force(spark):
    rnd = random.Random(8)
    items = [[rnd.choice(VOCAB) for _ in range(rnd.randint(15, 60))] for _ in range(12)]
    docs, want = [], set()
    for k in range(60):
        d = [rnd.choice(VOCAB) for _ in range(80)]
        if k % 2:
            it = rnd.choice(items)
            n = rnd.choice([12, 18, 20, 25, 40])
            a = rnd.randint(0, max(0, len(it) - n))
            part = it[a : a + n]
            for _ in range(rnd.choice([0, 1, 2, 6])):
                if part:
                    i = rnd.randrange(len(part))
                    part = rnd.choice([part[:i] + part[i + 1 :], part[:i] + [rnd.choice(VOCAB)] + part[i + 1 :], part[:i] + [rnd.choice(VOCAB)] + part[i:]])
            d[30:30] = part
        docs.append(d)
    for k, d in enumerate(docs):
        for i, it in enumerate(items):
            if edit_distance_window(d, it):
                want.add((k, i))
    rows = [(k, " ".join(w.upper() if rnd.random() < 0.3 else w + "," for w in d)) for k, d in enumerate(docs)] + [(900, None), (901, ""), (902, " ".join(docs[1] * 100))]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").withColumn("item_id", F.lit(-1)).withColumn("h", F.lit("clash"))
    it = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, ""), (92, "corto")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(df, it).collect() if r.doc_id < 900}
    # all within the strict limit are found; beyond it only what the looser verification rate lets through
    assert want <= got
    assert all(edit_distance_window(docs[k], items[i], 20, 0.15) for k, i in got - want)
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(df, it, block=5).collect() if r.doc_id < 900} == got
    assert leakage.leaked(df.limit(0), it).count() == 0 and leakage.leaked(df, it.limit(0)).count() == 0


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_rake_meets_targets():
    rnd = np.random.default_rng(9)
    cells = pd.DataFrame([(s, g, t, int(rnd.integers(100, 5000))) for s in "abc" for g in ("it", "de") for t in ("x", "y")], columns=["source", "lang", "topic", "tokens"])
    shares, caps = {"a": 0.5, "b": 0.3, "c": 0.1, "none": 0.1}, {"a": 1, "b": 3, "c": 2, "none": 2}
    w, total = mixing.rake(cells, shares, caps)
    got = (w["weight"] * w["tokens"]).groupby(w["source"]).sum() / total
    assert got["a"] == pytest.approx(0.5 / 0.9) and got["b"] == pytest.approx(0.3 / 0.9) and got["c"] == pytest.approx(0.1 / 0.9)
    assert (w["weight"] <= w["source"].map(caps) + 1e-9).all() and total > 0
    assert mixing.rake(cells, {"none": 1.0}, {"none": 1})[1] == 0


def test_mix(spark):
    rnd = random.Random(10)
    rows = [(i, "parola " * rnd.randint(1, 60), rnd.choice(["Albo-Pretorio", "albo_pretorio", "verbali", "ignoto", None]), rnd.choice(["it", "IT", None, "de"])) for i in range(600)]
    rows += [(1000, None, "verbali", "it"), (1001, "", "verbali", "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("weight", F.lit("clash")).withColumn("tokens", F.lit(1))
    t = spark.createDataFrame([("albo_pretorio", 0.5, 1), ("verbali", 0.4, 3), ("assente", 0.1, 2)], "source string, target_share double, max_repeats int")
    out, report = mixing.mix(df, t)
    caps = {"albo_pretorio": 1, "verbali": 3}
    got = out.collect()
    assert len(got) == 602 and all(r.copies <= caps.get(r.source, 0) for r in got)
    rep = {r.name: r for r in report.collect() if r.kind == "source"}
    assert rep["albo_pretorio"].reached_share == pytest.approx(0.5 / 0.9, abs=0.02) and rep["assente"].reached_share == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df, t)[0].collect()))
    assert mixing.mix(df.limit(0), t)[1].count() == 3 and mixing.mix(df, t.limit(0))[0].where("copies > 0").count() == 0


def test_marginals_are_reached_and_reported(spark):
    rnd = random.Random(4)
    words = {"it": ("acqua bosco fiume monte", "pane vino olio grano"), "de": ("Wasser Wald Fluss Berg", "Brot Wein Korn Salz")}
    rows = [(i, " ".join(rnd.choice(words[g][k].split()) for _ in range(50)), s, g) for i in range(1600) for s, g, k in [(rnd.choice("aab"), rnd.choice(["it", "it", "it", "de"]), rnd.randint(0, 1))]]
    rows += [(9000 + i, "solo una volta", "a", g) for i, g in enumerate(("xa", "xb", "xc"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out, report = mixing.mix(df, spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int"))
    rep = report.collect()
    assert {r.kind for r in rep} == {"source", "language", "topic"}
    for kind, slack in (("source", 0.01), ("language", 0.02), ("topic", 0.04)):
        mine = [r for r in rep if r.kind == kind]
        assert sum(r.reached_share for r in mine) == pytest.approx(1) and all(abs(r.reached_share - r.target_share) < slack for r in mine)
        assert sum(r.documents for r in mine) == len(rows)
    # a topic holds one subject of one language
    pure = out.join(df.select("doc_id", "text"), "doc_id").where("doc_id < 9000").select("topic", F.regexp_extract("text", "(?i)(acqua|bosco|fiume|monte|wasser|wald|fluss|berg)", 1).alias("w")).groupBy("topic").agg(F.count_distinct(F.col("w") != "").alias("n")).collect()
    assert all(r.n == 1 for r in pure) and len(pure) >= 4


def test_topics():
    assert mixing.Topics.fit(np.zeros((3, mixing.WIDTH))).of(np.array([1, 2])) == -1
    c = np.zeros((40, mixing.WIDTH))
    for i in range(40):
        c[i, [5, 6, 7] if i % 2 else [8, 9, 10]] = [3, 1 + i % 3, 2]
    t = mixing.Topics.fit(c, topics=2)
    assert t.of(np.array([5, 6])) == t.of(np.array([7] * 9)) != t.of(np.array([9])) and t.of(np.array([], np.int64)) == -1 == t.of(np.array([300]))


def test_topics_come_from_all_documents(spark):
    words = [["acqua bosco fiume monte", "pane vino olio grano"], ["Wasser Wald Fluss Berg", "Brot Wein Korn Salz"]]
    half = {r.doc_id: r.half for r in spark.range(4000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("half")).collect()}
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(words[half[i]][i % 2].split()) for _ in range(20)), "a", "it") for i in half]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.topic for r in mixing.mix(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))[0].collect()}
    seen = {}
    for i, t in got.items():
        seen.setdefault(t, set()).add((half[i], i % 2))
    assert len(got) == 4000 and -1 not in seen and all(len(x) == 1 for x in seen.values())


def test_topics_are_the_same_however_rows_are_spread(spark, monkeypatch):
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("ponte", "strada", "tributo", "scuola", "mensa") for b in ("", "le", "mento", "ria")]
    rows = [(i, " ".join(rnd.choice(words[k : k + 5]) for _ in range(rnd.randint(0, 40)))) for i in range(500) for k in [rnd.choice((0, 5, 10, 12))]]
    df = spark.createDataFrame(rows + [(500, None), (501, " \n")], "doc_id long, text string").withColumns({"source": F.lit("a"), "lang": F.lit("it")})
    held = mixing.learn_topics(mixing.counted_rows(df))
    monkeypatch.setattr(topics, "HELD", 0)
    for parts, got in ((1, topics.GOT), (7, 0)):
        monkeypatch.setattr(topics, "GOT", got)
        spread = mixing.learn_topics(mixing.counted_rows(df.repartition(parts, "text")))
        assert (spread.idf == held.idf).all() and (spread.centres == held.centres).all() and held.centres.shape[1] == mixing.TOPICS
    # every document with words counts
    enc = mixing._encoder(mixing.TOKENIZERS, mixing.VOCABULARY)
    sets = [{i % mixing.WIDTH for i in enc.encode_ordinary(t)} for _, t in rows if t]
    assert held.idf == pytest.approx([np.log(len(sets) / max(sum(k in x for x in sets), 1)) for k in range(mixing.WIDTH)])
    assert mixing.learn_topics(mixing.counted_rows(df.limit(0))).centres.shape[1] == 0


# ---- scans ---------------------------------------------------------------------------------------------------------

BODY = "Il funzionario registra la domanda con il progressivo 4241 presso lo sportello. La commissione verifica il documento nell'ambito economico-finanziario e archivia la relazione del mercato."


@pytest.fixture(scope="module")
def model(spark):
    rows = [(BODY,)] * 60 + [("Il dipartimento tecnico tutela la tettoia con il progressivo 12.",)] * 60 + [(None,), ("",)]
    for i in range(6):  # scans of several pages, each with its running header
        rows += [("\n".join(f"{BODY[:60]}\nFoglio del mercato – Salzuvra n. {40 + i}{f' {p}' if i % 2 else ''}\n{BODY[61:]}" for p in range(3)),)]
    return scans.learn(spark.createDataFrame(rows, "text string"))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Il funzio-\nnario registra", [(0, "hyphen")]), ("nell'ambito economico-\nfinanziario", []), ("la commissi0ne verifica", [(0, "ocr")]), ("la rclazione del mercato", [(0, "ocr")]), ("con il progressivo\n4241\npresso lo sportello", []),
        ("registra la\n17\ndomanda", [(1, "page")]), ("registra la\nPag. 9\ndomanda", [(1, "page")]), ("— 7 —", [(0, "page")]), ("registra\nFoglio del mercato – Salzuvra n. 45 12\nla domanda", [(1, "header")]), ("F0glio del mercato – Salzuvra n. 45", [(0, "header")]),
        ("il doc\xad\nPag. 3\numento", [(0, "hyphen"), (1, "page")]), ("", []), ("la domanda VE411", []),
    ],
)
def test_noise(model, text, want):
    assert [(i, k) for i, s in enumerate(scans.inspect(text, model)[1]) for k in sorted(s)] == want


def test_other_header_shapes(spark):
    """Headers are learned from what recurs: other furniture, another language, no number, one that stands once."""
    body = ["the clerk registers the request with the\nnumber 17 and sends the copy", "to the office of the lake. The board\nverifies the document and", "files the report of the market"]
    rows = []
    for i in range(12):
        name = ["Lake Council", "Hill Board", "Port Office", "Mill Trust"][i % 4]
        rows.append((str(i), "\n".join(f"{body[k % 3]}\n{name} * Minutes {i} * {k}" for k in range(4)) + "\nuntil the end.\nFees and charges\nThe clerk pays."))
        rows.append((f"n{i}", "\n".join(f"{b}\n{name} Annual Review" for b in body[:2]) + "\n" + body[2] + "."))
    rows.append(("once", f"{body[0]}\nPort Office * Minutes 31 * 2\n{body[1]}\n{body[2]}."))
    df = spark.createDataFrame(rows, "item_key string, text string").withColumn("src", F.lit("s"))
    got = {(r.item_key, r.line_no) for r in scans.noisy_lines(df).where("noise = 'header'").collect()}
    want = {(k, i) for k, t in rows for i, x in enumerate(t.split("\n")) if "* Minutes" in x or "Annual Review" in x}
    assert got == want


def test_newton_finds_the_association():
    rnd = np.random.default_rng(3)
    x = np.concatenate([np.eye(4)[[0, 1]], np.eye(4)])
    v = scans.newton(x, np.r_[1, 1, 0, 0, 0, 0], np.r_[80.0, 2.0, 10.0, 10.0, 10.0, 10.0], np.zeros(4), 30)
    assert v[0] > 1.5 and v[2] < -1 and v[3] < -1 and v[0] > v[1] > v[2]


def test_vectors_decide_by_context(spark):
    """Of two readings the context chooses; a rare word in a context that speaks for no reading stands."""
    rows = ["la barca porta pesce fresco dal lago"] * 80 + ["la banca presta denaro contro un pegno"] * 80 + ["il vento muove le foglie del parco"] * 40
    m = scans.learn(spark.createDataFrame([(r,) for r in rows], "text string"))
    assert m.support("barca", ["porta", "pesce"]) > 0.5 > m.support("banca", ["porta", "pesce"])
    assert m.support("banca", ["presta", "denaro"]) > 0.5 > m.support("barca", ["presta", "denaro"])
    assert m.correct("barea", ["la", "porta", "pesce"])[0] == "barca" and m.correct("barea", ["muove", "foglie"]) is None


def test_long_words_have_no_cut_off(model):
    w = "x" * 100_000
    assert model.variants(w) == [] and model.variants("c0mmissi0ne") == [("commissione", 1)]


def test_reflow(model):
    t = "Il funzio-\nnario registra la do-\nFoglio del mercato – Salzuvra n. 45\n— 7 —\nmanda con il\nprogressivo 12.\n\n- la commissi0ne verifica\nil documento\n- archivia"
    assert scans.reflow(t, model) == "Il funzionario registra la domanda con il progressivo 12.\n- la commissione verifica il documento\n- archivia"


def test_noisy_lines(spark, model):
    df = spark.createDataFrame([("a", "1", BODY.replace("domanda", "d0manda")), ("a", "2", None), ("a", "3", ""), ("b", "1", "x" * 200_000)], "src string, item_key string, text string").withColumn("noise", F.lit(1))
    got = scans.noisy_lines(df.unionByName(df), model)
    assert [tuple(r) for r in got.collect()] == [("a", "1", 0, "ocr")]
    assert scans.noisy_lines(df.limit(0)).count() == 0 and scans.repaired(df, model).count() == 3

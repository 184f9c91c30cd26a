"""Every query runs on the smallest tables and equals its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from scrivano.plans import catalogue
from scrivano.sources import readers


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in catalogue.oracle_sql():
        cur = duck.execute(catalogue.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_config():
    c = readers.load_config("input_path=x # y\nuse_ocr_for_pdf=TRUE\npoppler_path=none\nonly_llm_min_chars_per_chunk=5\nother=1")
    assert (c.input_path, c.use_ocr_for_pdf, c.poppler_path, c.only_llm_min_chars_per_chunk) == ("x", True, None, 5)


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_text("uno\ndue", encoding="utf-8")
    (tmp_path / "skip.md").write_text("x")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ciao</w:t></w:r></w:p><w:tbl/><w:p/></w:body></w:document>')
    got = {r.doc_id: r.text for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "uno\ndue", "b": "Ciao\n"}
    g = tmp_path / "doc1"
    g.mkdir()
    (g / "gold_agents.txt").write_text("S.U.A.P. | Sportello Unico\nRichiedente", encoding="utf-8")
    (g / "gold_procedures.txt").write_text("-----\nuno\n-----\ndue", encoding="utf-8")
    assert {(r.group_id, r.alias) for r in readers.gold_agents(spark, str(g / "gold_agents.txt")).collect()} == {(0, "suap"), (0, "sportello unico"), (1, "richiedente")}
    (g / "gold_titles.txt").write_text("Uno  due\n\nTre\r\n", encoding="utf-8")
    (g / "gold_agents_by_procedure.txt").write_text("suap, S.U.A.P.\nrichiedente\n-----\ncomune", encoding="utf-8")
    assert [(r.doc, r.idx, r.title) for r in readers.gold_titles(spark, str(g / "gold_titles.txt")).collect()] == [("doc1", 0, "Uno due"), ("doc1", 1, "Tre")]
    assert {(r.proc_idx, r.agent) for r in readers.gold_agents_by_procedure(spark, str(g / "gold_agents_by_procedure.txt")).collect()} == {(0, "suap"), (0, "richiedente"), (1, "comune")}
    assert [r.text for r in readers.gold_procedures(spark, str(g / "gold_procedures.txt")).orderBy("idx").collect()] == ["uno", "due"]


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "è")], "doc_id string, n int, t string")
    for _ in range(2):  # a second write replaces the first
        readers.write_json(df, str(tmp_path / "j"))
    back = readers.read_json(spark, str(tmp_path / "j" / "doc_id=b"), df.drop("doc_id").schema).collect()
    assert [(r.n, r.t) for r in back] == [(2, "è")]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "x.diagram_procedures.json").write_text("[]")
    assert [r.doc_id for r in readers.diagram_files(spark, str(tmp_path)).collect()] == ["x"]


def test_ocr_falls_back(monkeypatch):
    monkeypatch.setattr(readers, "pdf_text", lambda data: "testo proprio")
    fail = lambda data: 1 / 0
    assert readers.decode("a.PDF", b"", lambda data: " pagina uno\n")[0] == "pagina uno"
    assert readers.decode("a.pdf", b"", fail)[0] == "testo proprio" == readers.decode("a.pdf", b"", lambda data: " ")[0] == readers.decode("a.pdf", b"")[0]


def test_entry_stands_without_the_subpackage(monkeypatch):
    """A missing dependency of the optional part leaves the core queries."""
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kw):
        if name.split(".")[0] == "xxhash":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m.startswith("scrivano.llm") or m == "xxhash"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())

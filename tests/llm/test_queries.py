"""The registered queries run on the smallest tables with the columns they must have."""

import pytest

from scrivano.llm import queries as Q

COLUMNS = {
    "p1_found": "first_def_id bigint, term_def_id bigint, definition_def_id bigint, line_def_id bigint",
    "p2_found": "field string, row_id bigint, pos int, agent_id int",
    "p3_found": "doc_id string, name_a string, name_b string",
    "p4_found": "src string, item_key string, line_no int, noise string",
    "p5_found": "src string, item_key string, cut string",
    "p6_found": "doc_id bigint, item_id bigint",
    "p8_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    df = Q.queries()[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        rows = df.collect()
        assert len(rows) == len(set(rows)) and (rows or name == "p6_found")
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "diagram_procedures", "procedure_records"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    cur = con.execute(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, data)
    assert [x[0] for x in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())

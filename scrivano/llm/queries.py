"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from scrivano.llm import canonical, fusion, leakage, mixing, repetition, scans, segment, variants
from scrivano.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = variants.typed_names(table(spark, d, "definitions_raw"), table(spark, d, "prompt_blocks"))
    return variants.variant_pairs(variants.link_names(rows))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.chosen(table(spark, d, "definitions_raw"), table(spark, d, "documents"), table(spark, d, "extractors"))
    return best.select("first_def_id", "term_def_id", "definition_def_id", "line_def_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "agent_registry")
    rows = canonical.map_typed_agents(table(spark, d, "definitions_normalized"), table(spark, d, "prompt_blocks"), reg)
    names = reg.select(F.col("canonical_agent").alias("value")).where("value is not null").distinct()
    return rows.join(names, "value", "left_anti").select(
        "field", "row_id", "pos", F.coalesce(F.col("id").cast("int"), F.lit(-1)).alias("agent_id")
    )


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return scans.scanned_items(table(spark, d, "diagram_procedures"), table(spark, d, "prompt_blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(_scans(spark, d))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_scans(spark, d).dropDuplicates(["src", "item_key"]))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return segment.procedure_items(table(spark, d, "diagram_procedures"), table(spark, d, "procedure_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return segment.split_oversized(_items(spark, d)).select("src", "item_key", "cut").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = segment.oversized(_items(spark, d)).dropDuplicates(["src", "item_key"])
    return segment.split_oversized(items)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("source").isNotNull() & F.col("ente_code").isNotNull() & F.col("fetched_at").isNotNull()
    return repetition.repetition(table(spark, d, "documents"), known)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_repetition(spark, d).where("flagged").select("doc_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_repaired, p5_found, p5_pieces, p6_found, p7_mix, p7_report, p8_found, p8_repetition)}


WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ITEM = r"\n([^\S\n]*(?:[-–—•*·▪]|\d{1,3}[.)]|[A-Za-z]\))\s)"

#: Boundaries become chr(1); white space around stretches does not count, so its place among blanks doesn't either.
P5 = rf"""WITH t0 AS (SELECT DISTINCT procedure_id, original_text_full AS t FROM diagram_procedures WHERE length(original_text_full) > {segment.TEXT_LIMIT}),
t1 AS (SELECT procedure_id, regexp_replace(regexp_replace(t, '{ITEM}', chr(10) || chr(1) || '\1', 'g'), '{ITEM}', chr(10) || chr(1) || '\1', 'g') AS t FROM t0),
t2 AS (SELECT procedure_id, regexp_replace(regexp_replace(regexp_replace(t, '([.!?…]+["”»'')\]]*)({WS})', '\1' || chr(1) || '\2', 'g'), '([;:])({WS})', '\1' || chr(1) || '\2', 'g'), '\n([^\S\n]*)\n', chr(10) || chr(1) || '\1' || chr(10), 'g') AS t FROM t1),
tx AS (SELECT procedure_id, max(length(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g'))) AS longest FROM (SELECT procedure_id, unnest(string_split(t, chr(1))) AS x FROM t2) GROUP BY procedure_id),
e0 AS (SELECT DISTINCT procedure_id, evidence_chunk_ids AS ids FROM procedure_records WHERE len(evidence_chunk_ids) > {segment.ID_LIMIT}),
e1 AS (SELECT procedure_id, i, regexp_extract(coalesce(ids[i], ''), '_(definition|passage)_', 1) AS kind FROM e0, unnest(generate_series(1, len(ids))) AS u(i)),
e2 AS (SELECT *, i - row_number() OVER (PARTITION BY procedure_id, kind ORDER BY i) AS run FROM e1), ex AS (SELECT procedure_id, max(n) AS longest FROM (SELECT procedure_id, kind, run, count(*) AS n FROM e2 GROUP BY ALL) GROUP BY procedure_id)
SELECT 'text' AS src, procedure_id AS item_key, CASE WHEN longest <= {segment.TEXT_LIMIT} THEN 'natural' ELSE 'forced' END AS cut FROM tx UNION ALL SELECT 'evidence', procedure_id, CASE WHEN longest <= {segment.ID_LIMIT} THEN 'natural' ELSE 'forced' END FROM ex"""

#: Words in a phrase of five stated before, or in a loop of one to four words run through at least three times.
P8 = r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS ws FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, i, ws[i] AS w, len(ws) AS n FROM t, unnest(generate_series(1, len(ws))) AS u(i)),
g AS (SELECT *, CASE WHEN i + 4 <= n THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i, n, w, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 THEN 1 ELSE 0 END AS again FROM g),
m AS (SELECT doc_id, i, n, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM a),
s AS (SELECT doc_id, i, p FROM (SELECT doc_id, i, unnest([1, 2, 3, 4]) AS p, unnest([w = lag(w, 1) OVER o, w = lag(w, 2) OVER o, w = lag(w, 3) OVER o, w = lag(w, 4) OVER o]) AS same FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE same),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS run FROM s), l AS (SELECT doc_id, i FROM r QUALIFY count(*) OVER (PARTITION BY doc_id, p, run) >= greatest(2 * p, 3)),
c AS (SELECT m.doc_id, any_value(n) AS n, count(*) FILTER (WHERE hit = 1 OR l.i IS NOT NULL) AS k FROM m LEFT JOIN (SELECT DISTINCT doc_id, i FROM l) l USING (doc_id, i) GROUP BY m.doc_id)
SELECT doc_id FROM c WHERE 10 * k >= 4 * n"""


def oracle_sql() -> dict:
    return {"p5_found": P5, "p8_found": P8}

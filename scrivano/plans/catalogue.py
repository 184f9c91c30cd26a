"""All queries of the core, with the SQL that DuckDB can run for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivano.functions import lexicon as L
from scrivano.functions import scores as S
from scrivano.functions import text as T
from scrivano.operators import chunks, context, definitions, evaluation, extraction, graph, lines, outline, retrieval, store
from scrivano.plans import diagrams, evaluate, pipeline
from scrivano.session import table
from scrivano.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


# ---- shared inputs -------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return lines.documents(table(spark, d, "documents"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.lines(_docs(spark, d))


def _re2(pattern: str) -> str:
    """RE2 repeats 1000 times at most."""
    return _q(pattern.replace("{5,1200}", "{5,1000}.{0,200}"))


WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def ratio_sql(c: str) -> str:
    alpha = rf"len(regexp_extract_all({c}, '\p{{L}}'))"
    return rf"(CASE WHEN {alpha} = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all({c}, '\p{{Lu}}'))::DOUBLE / {alpha} END)"


def words_sql(c: str) -> str:
    return f"len(list_filter(string_split({squeeze_sql(c)}, ' '), lambda w: w <> ''))"


LINES_SQL = rf"""
docs AS (SELECT CAST(doc_id AS VARCHAR) doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE regexp_matches(text, '\S')),
lns AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(ls[i], '\s+$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM docs), unnest(generate_series(1, len(ls))) AS t(i))"""

SCORE_SQL = rf"""
CASE WHEN s = '' OR length(s) > 160 OR regexp_matches(s, {_q(L.BULLET)}) OR contains(s, ',') THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
 (CASE WHEN regexp_matches(s, {_q(L.TITLE_NUMBER)}) THEN 0.45::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(s, {_q(L.re2_keyword_line())}) THEN 0.35::DOUBLE ELSE 0 END)
 + (CASE WHEN regexp_matches(s, '^[A-ZÀ-ÖØ-Þ]') THEN 0.18::DOUBLE ELSE 0 END) + (CASE WHEN {ratio_sql('s')} > 0.6::DOUBLE THEN 0.18::DOUBLE ELSE 0 END)
 + (CASE WHEN ends_with(s, ':') THEN 0.18::DOUBLE ELSE 0 END) + (CASE WHEN {words_sql('s')} BETWEEN 1 AND 10 THEN 0.10::DOUBLE ELSE 0 END)
 - (CASE WHEN regexp_matches(s, {_q(L.re2_words(L.COPULA_WORDS))}) THEN 0.15::DOUBLE ELSE 0 END) - (CASE WHEN ends_with(s, '.') AND {words_sql('s')} > 10 THEN 0.10::DOUBLE ELSE 0 END))) END"""

HEADING_SQL = rf"""(n <> '' AND (regexp_matches(n, {_q(L.TITLE_NUMBER)}) OR regexp_matches(n, {_q(L.re2_keyword_line())}) OR (ends_with(n, ':') AND length(n) <= 90 AND regexp_matches(n, '^[A-ZÀ-ÖØ-Þ]')) OR ({ratio_sql('n')} >= 0.75::DOUBLE AND {words_sql('n')} >= 2 AND length(n) <= 90)))"""

CANDS_SQL = rf"""{LINES_SQL},
keys AS (SELECT doc_id, line_no, upper({squeeze_sql('line')}) AS key FROM lns),
rep AS (SELECT doc_id, key, count(*) AS n FROM keys WHERE length(key) >= 8 AND NOT regexp_matches(key, '^[0-9\s]+$') GROUP BY ALL HAVING count(*) >= 3),
cur AS (SELECT l.doc_id, l.line_no, {strip_sql('l.line')} AS s, {strip_sql("lead(l.line, 1, '') OVER (PARTITION BY l.doc_id ORDER BY l.line_no)")} AS n, k.key FROM lns l JOIN keys k USING (doc_id, line_no)),
scored AS (SELECT *, {SCORE_SQL} AS score FROM cur),
cands AS (SELECT doc_id, line_no, s AS candidate, score FROM scored WHERE score >= 0.22::DOUBLE AND (NOT regexp_matches(s, {_q('(?i)' + L.BARE_ATTACHMENT)}) OR {HEADING_SQL})
 AND NOT EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = scored.doc_id AND rep.key = scored.key) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 900)"""


# ---- lines and titles ----------------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {strip_sql('line')} = '') AS n_blank, max(length(line)) AS longest FROM lns GROUP BY doc_id")
def line_stats(spark, d):
    return lines.line_stats(_lines(spark, d))


@query(f"WITH {LINES_SQL} SELECT 'line_' || left(sha1('line:' || doc_id || '|' || line_no), 16) AS id, doc_id, line_no, {strip_sql('line')} AS text FROM lns WHERE {strip_sql('line')} <> ''")
def line_chunks(spark, d):
    return lines.line_chunks(_lines(spark, d))


@query(f"WITH {CANDS_SQL} SELECT doc_id, key, n FROM rep")
def repeated_headers(spark, d):
    return lines.repeated_headers(_lines(spark, d))


@query(f"WITH {CANDS_SQL} SELECT doc_id, line_no, round(score, 6) AS score FROM scored WHERE s <> ''")
def title_scores(spark, d):
    s = T.strip(F.col("line"))
    return _lines(spark, d).where(s != "").select("doc_id", "line_no", F.round(S.title_score(F.col("line")), 6).alias("score"))


@query(f"WITH {CANDS_SQL} SELECT doc_id, line_no, candidate, round(score, 6) AS score FROM cands")
def title_candidates(spark, d):
    return lines.title_candidates(_lines(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {CANDS_SQL} SELECT doc_id, line_no, candidate, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rank FROM cands QUALIFY rank <= 5")
def title_topk(spark, d):
    return lines.title_topk(lines.title_candidates(_lines(spark, d)), 5).withColumn("score", F.round("score", 6))


@query(f"""WITH {CANDS_SQL}, ctx AS (SELECT doc_id, line_no, array_to_string(list(line_no || ':' || line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '|') AS context FROM lns)
SELECT doc_id, line_no, context, round_even({ratio_sql('candidate')}, 3) AS upper_ratio, regexp_matches(candidate, {_q(L.TITLE_NUMBER)}) AS has_number_prefix, {words_sql('candidate')} AS word_count
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rank FROM cands QUALIFY rank <= 220) JOIN ctx USING (doc_id, line_no)""")
def title_items(spark, d):
    t = lines.title_items(_lines(spark, d))
    ctx = F.array_join(F.transform("context_lines", lambda x: F.concat_ws(":", x.line_no.cast("string"), x.text)), "|")
    return t.select("doc_id", "line_no", ctx.alias("context"), "features.upper_ratio", "features.has_number_prefix", "features.word_count")


PATTERN_SQL = rf"""'title_pattern :: ' || coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(q, {_q(L.TITLE_NUMBER)}) THEN 'NUM_PREFIX' END, CASE WHEN ends_with(q, ':') THEN 'ENDS_COLON' END,
 CASE WHEN regexp_matches(q, {_q('(?i)' + L.BARE_ATTACHMENT)}) THEN 'BARE_ALLEGATO' END, CASE WHEN {ratio_sql('q')} >= 0.65::DOUBLE THEN 'HIGH_UPPER' END], lambda x: x IS NOT NULL), ' | '), ''), 'GENERIC') || ' :: ' ||
 array_to_string(list_transform(list_filter(string_split(q, ' '), lambda x: x <> '')[1:10], lambda t: CASE WHEN regexp_matches(t, '^\p{{Nd}}+$') THEN '<NUM>' WHEN regexp_matches(t, '^[A-ZÀ-Ü]+$') THEN '<ALLCAPS>' WHEN regexp_matches(t, '^[A-ZÀ-Ü][a-zà-ü]+$') THEN '<CAP>' WHEN regexp_matches(t, '\p{{Nd}}') THEN '<ALNUM>' ELSE '<LOW>' END), ' ')"""


@query(f"WITH {CANDS_SQL} SELECT pattern, count(*) AS n FROM (SELECT {PATTERN_SQL} AS pattern FROM (SELECT {squeeze_sql('candidate')} AS q FROM cands)) GROUP BY pattern")
def title_patterns(spark, d):
    c = lines.title_candidates(_lines(spark, d))
    return c.groupBy(T.title_pattern(F.col("candidate")).alias("pattern")).agg(F.count("*").alias("n"))


@query(f"""WITH {CANDS_SQL}, p AS (SELECT doc_id AS source_doc, {PATTERN_SQL} AS pattern FROM (SELECT doc_id, {squeeze_sql('candidate')} AS q FROM cands))
SELECT 'title_pattern_' || left(sha1('title_pattern::' || pattern), 24) AS id, 'title_pattern' AS label, pattern, min(source_doc) AS source_doc FROM p GROUP BY pattern""")
def pattern_bank(spark, d):
    c = lines.title_candidates(_lines(spark, d))
    return store.pattern_rows(c.select(F.lit("title_pattern").alias("label"), T.title_pattern(F.col("candidate")).alias("pattern"), F.col("doc_id").alias("source_doc")))


# ---- procedural signals --------------------------------------------------------------------------------------------

_T = strip_sql("text")
PROC_SQL = rf"""least(1.0::DOUBLE, (CASE WHEN regexp_matches(t, {_q(L.BULLET)}) THEN 0.30::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches(t, {_q(L.re2_words(L.DEONTIC_WORDS))}) THEN 0.25::DOUBLE ELSE 0 END)
 + (CASE WHEN regexp_matches(t, {_q(L.re2_words(L.SEQUENCE_WORDS))}) THEN 0.15::DOUBLE ELSE 0 END)"""
PROC_RAG_SQL = PROC_SQL + rf" + (CASE WHEN regexp_matches(t, {_q(L.re2_words(L.IMPERATIVE_WORDS))}) THEN 0.20::DOUBLE ELSE 0 END))"


@query(f"""WITH {LINES_SQL} SELECT doc_id, round({PROC_RAG_SQL}, 6) AS rag, round({PROC_SQL}), 6) AS guided FROM (SELECT doc_id, {_T} AS t FROM docs)""")
def procedural_scores(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(S.procedural_score(x, "rag"), 6).alias("rag"), F.round(S.procedural_score(x, "guided"), 6).alias("guided"))


@query(f"""WITH b AS (SELECT procedure_id, section_title, lower(left({squeeze_sql('original_text_full')}, 1200)) AS t FROM diagram_procedures WHERE original_text_full IS NOT NULL)
SELECT DISTINCT procedure_id, 'procedural_section_pattern :: ' || coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(coalesce(section_title, ''), {_q(L.re2_words(L.TITLE_HINT_WORDS))}) THEN 'TITLE_PROC_HINT' END,
 CASE WHEN regexp_matches(t, {_q(L.re2_words(L.SECTION_FLAGS[0][1]))}) THEN 'DEONTIC' END, CASE WHEN regexp_matches(t, {_q(L.re2_words(L.SECTION_FLAGS[1][1]))}) THEN 'SEQUENCE' END,
 CASE WHEN regexp_matches(t, '(^|\\s)(1[\\)\\.]|2[\\)\\.]|3[\\)\\.])') THEN 'ENUMERATION' END, CASE WHEN regexp_matches(t, {_q(L.re2_words(L.SECTION_FLAGS[2][1]))}) THEN 'ADMIN_LEXICON' END], lambda x: x IS NOT NULL), ' | '), ''), 'GENERIC') AS pattern FROM b""".replace("\\\\", "\\"))
def section_patterns(spark, d):
    p = table(spark, d, "diagram_procedures").where("original_text_full is not null")
    return p.select("procedure_id", T.section_pattern(F.col("section_title"), F.col("original_text_full"), F.lit(True)).alias("pattern")).distinct()


# ---- outlines and sections -----------------------------------------------------------------------------------------


def _titles(spark, d) -> DataFrame:
    c = lines.title_candidates(_lines(spark, d)).where("score >= 0.45")
    return c.select("doc_id", F.col("line_no").alias("start_line"), F.when(T.upper_ratio(F.col("candidate")) >= 0.75, 1).when(S.numbered(F.col("candidate")), 3).otherwise(2).alias("level"), F.col("candidate").alias("title"))


TREE_SQL = rf"""{CANDS_SQL},
tt AS (SELECT doc_id, line_no AS start_line, candidate AS title, CASE WHEN {ratio_sql('candidate')} >= 0.75::DOUBLE THEN 1 WHEN regexp_matches(candidate, {_q(L.TITLE_NUMBER)}) THEN 3 ELSE 2 END AS level FROM cands WHERE score >= 0.45::DOUBLE),
ti AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS idx FROM tt),
tree AS (SELECT a.doc_id, a.idx, a.title, a.level, a.start_line,
 (SELECT min(b.start_line) - 1 FROM ti b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level) AS end_line,
 (SELECT max(b.idx) FROM ti b WHERE b.doc_id = a.doc_id AND b.idx < a.idx AND b.level < a.level) AS parent_index FROM ti a),
nl AS (SELECT doc_id, count(*) AS n_lines FROM lns GROUP BY doc_id),
secs AS (SELECT doc_id, coalesce(idx, 0) AS sec_idx, coalesce(start_line, 0) AS start_line, coalesce(end_line, n_lines - 1) AS end_line, coalesce(title, 'DOCUMENTO') AS title FROM nl LEFT JOIN tree USING (doc_id)),
sid AS (SELECT *, 'sec_' || left(sha1('sec:' || doc_id || '|' || start_line || '|' || end_line || '|' || left(title, 80)), 16) AS section_id FROM secs)"""


@query(f"WITH {TREE_SQL} SELECT doc_id, idx, title, level, start_line, end_line, parent_index FROM tree")
def outline_tree(spark, d):
    return outline.outline(_titles(spark, d)).drop("path")


@query(f"""WITH RECURSIVE {TREE_SQL}, paths AS (SELECT doc_id, idx, title AS path FROM tree WHERE parent_index IS NULL UNION ALL SELECT t.doc_id, t.idx, p.path || ' > ' || t.title FROM tree t JOIN paths p ON t.doc_id = p.doc_id AND t.parent_index = p.idx)
SELECT doc_id, idx, path FROM paths""")
def outline_paths(spark, d):
    return outline.outline(_titles(spark, d)).select("doc_id", "idx", "path")


def _sections(spark, d) -> DataFrame:
    n = _lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return outline.sections(outline.outline(_titles(spark, d)), n)


@query(f"WITH {TREE_SQL} SELECT doc_id, sec_idx, start_line, end_line, title, section_id FROM sid")
def section_bounds(spark, d):
    return _sections(spark, d).drop("path")


@query(f"""WITH {TREE_SQL}, st AS (SELECT s.doc_id, s.sec_idx, string_agg(l.line, chr(10) ORDER BY l.line_no) AS raw FROM sid s JOIN lns l ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY ALL)
SELECT doc_id, sec_idx, length(text) AS chars, sha1(text) AS digest FROM (SELECT doc_id, sec_idx, {strip_sql('raw')} AS text FROM st) WHERE text <> ''""")
def section_text(spark, d):
    t = outline.section_texts(_sections(spark, d), _lines(spark, d))
    return t.select("doc_id", "sec_idx", F.length("text").alias("chars"), F.sha1("text").alias("digest"))


@query(f"""WITH RECURSIVE {TREE_SQL}, paths AS (SELECT doc_id, idx, title AS path FROM tree WHERE parent_index IS NULL UNION ALL SELECT t.doc_id, t.idx, p.path || ' > ' || t.title FROM tree t JOIN paths p ON t.doc_id = p.doc_id AND t.parent_index = p.idx),
st AS (SELECT s.doc_id, s.sec_idx, s.section_id, s.title, string_agg(l.line, chr(10) ORDER BY l.line_no) AS raw FROM sid s JOIN lns l ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY ALL)
SELECT 'sec_doc_' || left(sha1('sec_doc:' || st.doc_id || '|' || section_id), 16) AS id, st.doc_id, section_id, title, coalesce(path, 'DOCUMENTO') AS path, title || chr(10) || coalesce(path, 'DOCUMENTO') || chr(10) || chr(10) || left(text, 1200) AS text
FROM (SELECT *, {strip_sql('raw')} AS text FROM st) st LEFT JOIN paths p ON p.doc_id = st.doc_id AND p.idx = st.sec_idx WHERE text <> ''""")
def section_parents(spark, d):
    return outline.parent_chunks(outline.section_texts(_sections(spark, d), _lines(spark, d)))


@query(f"WITH {TREE_SQL} SELECT doc_id, line_no, (SELECT min_by(section_id, sec_idx) FROM sid WHERE sid.doc_id = lns.doc_id AND line_no BETWEEN start_line AND end_line) AS section_id FROM lns")
def line_to_section(spark, d):
    return outline.line_sections(_lines(spark, d), _sections(spark, d))


@query(f"""WITH {TREE_SQL}, sp AS (SELECT DISTINCT doc_id, procedure_id AS span_id, start_line AS a, end_line AS b FROM procedure_records WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
ov AS (SELECT sp.*, section_id, sec_idx, least(end_line, greatest(a, b)) - greatest(start_line, least(a, b)) + 1 AS overlap FROM sp JOIN sid USING (doc_id)),
best AS (SELECT doc_id, span_id, section_id, overlap FROM ov WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, span_id ORDER BY overlap DESC, sec_idx) = 1)
SELECT doc_id, span_id, a, b, section_id, overlap FROM sp LEFT JOIN best USING (doc_id, span_id)""")
def span_to_section(spark, d):
    sp = table(spark, d, "procedure_records").where("start_line is not null and end_line is not null").select("doc_id", F.col("procedure_id").alias("span_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b")).distinct()
    return outline.span_sections(sp, _sections(spark, d))


# ---- chunks --------------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES_SQL}, isl AS (SELECT *, sum(CASE WHEN {strip_sql('line')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lns)
SELECT doc_id, min(line_no) AS line_start, max(line_no) AS line_end, sha1({strip_sql("string_agg(line, chr(10) ORDER BY line_no)")}) AS digest FROM isl WHERE {strip_sql('line')} <> '' GROUP BY doc_id, g""")
def paragraphs(spark, d):
    return chunks.paragraphs(_lines(spark, d)).select("doc_id", "line_start", "line_end", F.sha1("text").alias("digest"))


_PIECES = f"""{LINES_SQL}, isl AS (SELECT *, sum(CASE WHEN {strip_sql('line')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lns),
par AS (SELECT doc_id, min(line_no) AS line_start, max(line_no) AS line_end, {strip_sql("string_agg(line, chr(10) ORDER BY line_no)")} AS t FROM isl WHERE {strip_sql('line')} <> '' GROUP BY doc_id, g),
pk AS (SELECT *, CASE WHEN length(t) <= 1200 THEN [t] ELSE string_split(list_reduce(string_split(regexp_replace(t, '([.;:]){WS}+', '\\1' || chr(2), 'g'), chr(2)), lambda a, p: CASE WHEN length(list_last(string_split(a, chr(1)))) + length(p) + 2 > 1200 THEN a || chr(1) || p ELSE a || ' ' || p END), chr(1)) END AS ps FROM par),
pc AS (SELECT doc_id, line_start, line_end, i, {strip_sql('ps[i]')} AS text FROM pk, unnest(generate_series(1, len(ps))) AS u(i)),
pn AS (SELECT doc_id, line_start, line_end, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_start, i) - 1 AS chunk_id FROM pc WHERE text <> '')"""


@query(f"WITH {_PIECES} SELECT 'passage_' || left(sha1('passage:' || doc_id || '|' || line_start || '|' || line_end || '|' || chunk_id), 16) AS id, doc_id, chunk_id, line_start, line_end, text FROM pn")
def passages(spark, d):
    return chunks.passages(_lines(spark, d))


@query(r"""WITH RECURSIVE t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents WHERE regexp_matches(text, '\S')),
c AS (SELECT doc_id, text, 0 AS chunk_id, 0 AS s, CAST(NULL AS BIGINT) AS e, 0 AS nxt FROM t UNION ALL
 SELECT doc_id, text, CASE WHEN e IS NULL THEN 0 ELSE chunk_id + 1 END, nxt, en, en FROM (SELECT *, CASE WHEN nxt + 2000 >= length(text) THEN length(text) WHEN hit <> '' THEN nxt + 2000 + instr(w, hit) - 1 + length(hit) ELSE least(length(text), nxt + 3000) END AS en
  FROM (SELECT *, substr(text, nxt + 2001, 1000) AS w, regexp_extract(substr(text, nxt + 2001, 1000), '([\.!?])(\s|\n)|(\n{2,})|(;)(\s|\n)', 0) AS hit FROM c WHERE nxt < length(text))))
SELECT doc_id, chunk_id, s AS start_char, e AS end_char, substr(text, s + 1, e - s) AS text FROM c WHERE e IS NOT NULL""".replace("\\\\", "\\"))
def blind_chunks(spark, d):
    return chunks.blind_chunks(lines.documents(table(spark, d, "documents"), rstrip=False))


@query("""WITH d AS (SELECT DISTINCT doc_id, def_id, term, definition, section_id, line_no FROM definitions_raw WHERE regexp_replace(coalesce(definition, ''), '^\\s+|\\s+$', '', 'g') <> '')
SELECT doc_id, count(*) AS chunks, max(length(left(regexp_replace(coalesce(term, ''), '^\\s+|\\s+$', '', 'g') || ': ' || regexp_replace(definition, '^\\s+|\\s+$', '', 'g'), 900))) AS longest FROM d GROUP BY doc_id""".replace("\\\\", "\\"))
def definition_chunks(spark, d):
    c = chunks.definition_chunks(table(spark, d, "definitions_raw").dropDuplicates(["def_id"]))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@query("SELECT doc_id, CASE WHEN n <= 0 THEN 50 ELSE greatest(18, least(50, CAST(round_even(50 * (CASE WHEN n >= 8000 THEN 0.45::DOUBLE WHEN n >= 4000 THEN 0.60::DOUBLE WHEN n >= 2000 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END), 0) AS INT))) END AS k FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(length(text), 0) AS n FROM documents)")
def adaptive_k(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), T.adaptive_k(F.coalesce(F.length("text"), F.lit(0)), 50, 18, 50).alias("k"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN length(text) <= 650 THEN text ELSE regexp_replace(CASE WHEN length(left(text, 650)) - instr(reverse(left(text, 650)), chr(10)) >= 487 AND instr(reverse(left(text, 650)), chr(10)) > 0
 THEN left(text, length(left(text, 650)) - instr(reverse(left(text, 650)), chr(10))) ELSE left(text, 650) END, '\\s+$', '') || chr(10) || '...[TRUNCATED]...' END AS text FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def truncated_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), T.truncate(F.col("text"), 650).alias("text"))


@query(f"SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t ELSE left(t, 750) || chr(10) || chr(10) || '...[TRUNCATED]...' || chr(10) || chr(10) || right(t, 250) END AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {strip_sql('text')} AS t FROM documents WHERE text IS NOT NULL)")
def trimmed_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), T.trim_section(F.col("text"), 1000).alias("text"))


# ---- retrieval -----------------------------------------------------------------------------------------------------


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("parent"))
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("parent")), items


_DIST = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"
_NEAR = f"near AS (SELECT q.vec_id AS query_id, q.label AS qlabel, e.vec_id AS id, e.label AS parent, {_DIST} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"


@query(f"WITH {_NEAR} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM near QUALIFY rank <= 10")
def knn_topk(spark, d):
    q, items = _vectors(spark, d)
    return retrieval.knn(q.select("query_id", "qvec"), items.select("id", "vec"), 10)


@query("""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS distance
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, abs(distance) AS distance FROM near QUALIFY rank <= 10""")
def knn_cosine(spark, d):
    q, items = _vectors(spark, d)
    return retrieval.knn(q.select("query_id", "qvec"), items.select("id", "vec"), 10, metric=retrieval.cosine_distance).withColumn("distance", F.abs("distance"))


@query(f"WITH {_NEAR} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM near WHERE parent = qlabel QUALIFY rank <= 6")
def knn_filtered(spark, d):
    q, items = _vectors(spark, d)
    return retrieval.knn(q, items, 6, on=["parent"])


@query(f"WITH {_NEAR}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 10) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place, id, rank, id AS pos FROM top")
def knn_ordered(spark, d):
    q, items = _vectors(spark, d)
    return retrieval.ordered(retrieval.knn(q.select("query_id", "qvec"), items.select("id", "vec"), 10), items.select("id", F.col("id").alias("pos")))


@query(f"""WITH par AS (SELECT label AS parent, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
pn AS (SELECT q.vec_id AS query_id, e.parent, {_DIST} AS distance FROM par e, embeddings q WHERE q.vec_id % 100 = 0),
pr AS (SELECT query_id, parent, row_number() OVER (PARTITION BY query_id ORDER BY distance, parent) AS parent_rank FROM pn QUALIFY parent_rank <= 3),
{_NEAR}, ch AS (SELECT n.query_id, pr.parent_rank, n.parent, n.id, n.distance, row_number() OVER (PARTITION BY n.query_id, n.parent ORDER BY n.distance, n.id) AS r FROM near n JOIN pr ON pr.query_id = n.query_id AND pr.parent = n.parent QUALIFY r <= 4)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY parent_rank, r) AS place, parent, id, distance FROM ch""")
def knn_parent_child(spark, d):
    q, items = _vectors(spark, d)
    parents = items.groupBy("parent").agg(F.min_by("vec", "id").alias("vec")).select(F.col("parent").alias("id"), "vec")
    return retrieval.parent_child(q.select("query_id", "qvec"), parents, items)


@query(f"""WITH {_NEAR}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 10),
f AS (SELECT qlabel AS group_id, id, min(struct_pack(query_no := query_id, rank := rank)) AS f FROM top GROUP BY ALL)
SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY f.query_no, f.rank, id) AS place, id, f.query_no AS query_no, f.rank AS rank FROM f QUALIFY place <= 30""")
def multi_query(spark, d):
    q, items = _vectors(spark, d)
    hits = retrieval.knn(q.select("query_id", "qvec"), items.select("id", "vec"), 10).join(q.select("query_id", F.col("parent").alias("group_id")), "query_id")
    return retrieval.merge_queries(hits.select("group_id", F.col("query_id").alias("query_no"), "rank", "id"), 30)


@query()
def text_retrieval(spark, d):
    """For one procedure in a hundred, by hash, the procedures nearest by the offline embedder, own document left out; all
    procedures are searched."""
    p = table(spark, d, "diagram_procedures").where("original_text_full is not null").dropDuplicates(["procedure_id"])
    v = p.select(F.col("procedure_id").alias("id"), F.col("doc_id").alias("doc"), F.concat_ws(" ", "section_title", "original_text_full").alias("vec"))
    q = v.where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), "doc")
    hits = retrieval.knn(q.select("query_id", "qvec"), v.select("id", "vec"), 6).join(v.select("id", F.col("doc").alias("source_doc")), "id")
    return retrieval.without_own(hits, q.select("query_id", "doc"))


# ---- definitions and agents ----------------------------------------------------------------------------------------


def _defs(spark, d) -> DataFrame:
    return table(spark, d, "definitions_raw").dropDuplicates(["def_id"])


_DEFS = "d AS (SELECT DISTINCT def_id, doc_id, term, definition, line_no, section_id FROM definitions_raw)"

DEFLINE_SQL = rf"""(length(s) >= 6 AND NOT regexp_matches(s, {_q(L.BULLET)}) AND (regexp_matches(s, {_q(L.DEF_COLON)}) OR regexp_matches(s, {_q(L.DEF_DASH)}) OR regexp_matches(s, {_q('(?i)' + L.DEF_MEANS)}) OR regexp_matches(s, {_q('(?i)' + L.DEF_ACRONYM)})
 OR {' OR '.join(f"contains(lower(s), '{h}')" for h in L.DEF_HINTS)}))"""


def _goes(c: str) -> str:
    return rf"({c} <> '' AND NOT regexp_matches({c}, {_q(L.TITLE_NUMBER)}) AND NOT regexp_matches({c}, {_q(L.re2_keyword_line())}) AND NOT regexp_matches({c}, {_q(L.BULLET)}) AND regexp_matches({c}, '^\s*(?:[,;:\)\]]|[\p{{L}}\p{{N}}_]|/|-)') AND NOT (regexp_matches({c}, {_q(L.DEF_COLON)}) OR regexp_matches({c}, {_q(L.DEF_DASH)}) OR regexp_matches({c}, {_q('(?i)' + L.DEF_MEANS)})))"


@query(f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line_no, {strip_sql('line')} AS s, {strip_sql("lead(line, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no)")} AS l1, {strip_sql("lead(line, 2, '') OVER (PARTITION BY doc_id ORDER BY line_no)")} AS l2 FROM lns)
SELECT doc_id, line_no, text FROM (SELECT doc_id, line_no, CASE WHEN {_goes('l1')} AND {_goes('l2')} THEN s || ' ' || l1 || ' ' || l2 WHEN {_goes('l1')} THEN s || ' ' || l1 ELSE s END AS text FROM w WHERE {DEFLINE_SQL}) WHERE length(text) >= 8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 260""")
def definition_candidates(spark, d):
    return definitions.candidates(_lines(spark, d))


_TERM = rf"regexp_replace(regexp_replace({squeeze_sql('t')}, '^[ :;\-–—\s]+|[ :;\-–—\s]+$', '', 'g'), '^$', '')"


@query(rf"""WITH {LINES_SQL}, l AS (SELECT doc_id, line_no, {strip_sql('line')} AS s FROM lns), f AS ({' UNION ALL '.join(f"SELECT doc_id, line_no, {i} AS pat, regexp_extract(s, {_re2(p)}, 1) AS t, regexp_extract(s, {_re2(p)}, 2) AS x FROM l WHERE length(s) >= 12" for i, p in enumerate(L.TERM_PATTERNS))}),
c AS (SELECT doc_id, line_no, pat, {_TERM} AS term, {squeeze_sql('x')} AS definition FROM f), k AS (SELECT * FROM c WHERE length(term) BETWEEN 2 AND 60 AND lower(term) NOT IN ({', '.join(map(_q, L.STOP_TERMS))}) AND length(definition) >= 8
 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term), left(lower(definition), 80) ORDER BY line_no, pat) = 1) SELECT doc_id, line_no, pat, term, definition FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pat) <= 120""")
def definition_patterns(spark, d):
    return definitions.by_patterns(_lines(spark, d))


@query(rf"""WITH {LINES_SQL}, w AS (SELECT doc_id, line_no, {strip_sql('line')} AS s, {strip_sql("lead(line, 1, '') OVER (PARTITION BY doc_id ORDER BY line_no)")} AS l1, {strip_sql("lead(line, 2, '') OVER (PARTITION BY doc_id ORDER BY line_no)")} AS l2 FROM lns),
ca AS (SELECT doc_id, line_no, text FROM (SELECT doc_id, line_no, CASE WHEN {_goes('l1')} AND {_goes('l2')} THEN s || ' ' || l1 || ' ' || l2 WHEN {_goes('l1')} THEN s || ' ' || l1 ELSE s END AS text FROM w WHERE {DEFLINE_SQL}) WHERE length(text) >= 8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 260),
an AS (SELECT doc_id, line_no, regexp_extract(text, {_re2(L.TERM_PATTERNS[3])}, 1) AS t, regexp_extract(text, {_re2(L.TERM_PATTERNS[3])}, 2) AS x FROM ca), va AS (SELECT doc_id, line_no, {_TERM} AS term, left({squeeze_sql('x')}, 1200) AS definition FROM an WHERE t <> ''),
ok AS (SELECT *, lower({squeeze_sql('term')}) AS k FROM va WHERE length(term) BETWEEN 2 AND 60 AND length(definition) >= 8 AND NOT regexp_matches(term, {_q('(?i)' + L.DEF_BAD_TERM)})),
kl AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY length(definition) DESC, line_no) = 1)
SELECT doc_id, line_no, term, definition, row_number() OVER (PARTITION BY doc_id ORDER BY length(definition) DESC, line_no) AS rank FROM kl QUALIFY rank <= 140""")
def extracted_definitions(spark, d):
    """Definitions of the documents as the rule answers give them, without retrieval and sections."""
    lns = _lines(spark, d)
    none = spark.createDataFrame([], "doc_id string, sec_idx int, start_line int, end_line int, title string, path string, section_id string")
    return extraction.extract(lns, none, pipeline.rules(), "guided").select("doc_id", "line_no", "term", "definition", "rank")


DERIVED_SQL = rf"""
{_DEFS}, lns AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY def_id) - 1 AS line_no, replace(upper({squeeze_sql('term')}), ' ', '_') || ': ' || {squeeze_sql('definition')} AS line FROM d WHERE {squeeze_sql("coalesce(term, '')")} <> '' AND {squeeze_sql("coalesce(definition, '')")} <> '')"""


def _derived_lines(spark, d) -> DataFrame:
    """The recorded definitions as lines "TERM: definition", one document's after each other."""
    t, x = T.squeeze(F.coalesce("term", F.lit(""))), T.squeeze(F.coalesce("definition", F.lit("")))
    r = _defs(spark, d).select("doc_id", "def_id", t.alias("t"), x.alias("x")).where("t <> '' and x <> ''")
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("def_id")) - 1
    return r.select("doc_id", no.alias("line_no"), F.concat(F.replace(F.upper("t"), F.lit(" "), F.lit("_")), F.lit(": "), "x").alias("line"))


@query(SQL["definition_candidates"].replace(LINES_SQL, DERIVED_SQL))
def derived_definition_candidates(spark, d):
    return definitions.candidates(_derived_lines(spark, d))


@query(SQL["extracted_definitions"].replace(LINES_SQL, DERIVED_SQL))
def derived_definitions(spark, d):
    none = spark.createDataFrame([], "doc_id string, sec_idx int, start_line int, end_line int, title string, path string, section_id string")
    return extraction.extract(_derived_lines(spark, d), none, pipeline.rules(), "guided").select("doc_id", "line_no", "term", "definition", "rank")


@query(rf"""WITH {_DEFS}, t AS (SELECT doc_id, def_id, definition, {strip_sql('lower(term)')} AS k FROM d WHERE definition IS NOT NULL), f AS (SELECT doc_id, k, min_by(definition, def_id) AS definition FROM t WHERE k <> '' GROUP BY doc_id, k),
a AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(allowed_agents) AS term FROM prompt_blocks)) SELECT a.doc_id, a.term, f.definition FROM (SELECT * FROM a WHERE term IS NOT NULL) a LEFT JOIN f ON f.doc_id = a.doc_id AND f.k = {strip_sql('lower(a.term)')}""")
def matched_definitions(spark, d):
    a = table(spark, d, "prompt_blocks").select("doc_id", F.explode("allowed_agents").alias("term")).where("term is not null").distinct()
    return extraction.match_definition(a, _defs(spark, d).where("definition is not null"))


@query(rf"""WITH {_DEFS} SELECT def_id, replace(coalesce(term, ''), '|', '/') || ' | ' || replace(coalesce(definition, ''), '|', '/') || ' | ' || replace(coalesce(section_id, ''), '|', '/') || ' |  | ' || replace(coalesce(definition, ''), '|', '/') AS value FROM d""")
def definition_dump(spark, d):
    x = _defs(spark, d).select("def_id", "term", F.col("definition").alias("summary"), F.col("section_id").alias("section"), F.lit(None).cast("string").alias("subsection"), F.col("definition").alias("raw"))
    return x.select("def_id", readers.definition_line().alias("value"))


@query(f"""WITH {_DEFS}, k AS (SELECT *, {squeeze_sql('lower(term)')} AS k, lower(coalesce(section_id, '')) AS sk, length(coalesce(definition, '')) AS len FROM d),
b AS (SELECT * FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k, sk ORDER BY len DESC, def_id) = 1)
SELECT doc_id, def_id, term, definition, line_no, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, line_no NULLS LAST, def_id) AS rank FROM b QUALIFY rank <= 140""")
def definition_dedupe(spark, d):
    return definitions.keep_longest(_defs(spark, d))


@query("""WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, line_no, min(definition) AS ta FROM definitions_raw WHERE variant = 'rag' AND line_no IS NOT NULL AND definition IS NOT NULL GROUP BY ALL),
y AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, line_no, min(definition) AS tb FROM definitions_raw WHERE variant = 'no_rag_only' AND line_no IS NOT NULL AND definition IS NOT NULL GROUP BY ALL)
SELECT doc_id, line_no, CASE WHEN length(coalesce(tb, '')) > length(coalesce(ta, '')) THEN tb ELSE coalesce(ta, tb) END AS text FROM x FULL OUTER JOIN y USING (doc_id, line_no)""")
def definition_merge(spark, d):
    raw = table(spark, d, "definitions_raw").where("line_no is not null and definition is not null")
    side = lambda v: raw.where(F.col("variant") == v).groupBy("doc_id", "line_no").agg(F.min("definition").alias("text"))
    return definitions.merge_candidates(side("rag"), side("no_rag_only"))


@query(f"""WITH {_DEFS}, t AS (SELECT *, {strip_sql('term')} AS tt FROM d), k AS (SELECT doc_id, lower(tt) AS k, min(struct_pack(def_id := def_id, term := tt)) AS f FROM t
 WHERE tt <> '' AND (regexp_matches(tt, {_q(L.re2_words(L.ROLE_WORDS))}) OR regexp_matches(coalesce(definition, ''), {_q(L.re2_words(L.ROLE_WORDS))})) GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f.def_id, k) AS pos, f.term AS agent FROM k QUALIFY pos <= 40""")
def allowed_agents(spark, d):
    return definitions.allowed_agents(_defs(spark, d))


ALIAS_SQL = rf"""n AS (SELECT DISTINCT * FROM definitions_normalized),
na AS (SELECT doc_id, norm_id, {strip_sql('canonical_agent')} AS canonical, (CASE WHEN {strip_sql("coalesce(term, '')")} <> '' THEN [{strip_sql('term')}] ELSE []::VARCHAR[] END || coalesce(aliases, []::VARCHAR[]))[1:10] AS names FROM n WHERE is_agent AND {strip_sql("coalesce(canonical_agent, '')")} <> ''),
ne AS (SELECT doc_id, norm_id, canonical, i AS pos, {strip_sql('lower(names[i])')} AS alias FROM na, unnest(generate_series(1, len(names))) AS t(i)),
am AS (SELECT doc_id, alias, min(struct_pack(norm_id := norm_id, pos := pos, canonical := canonical)).canonical AS canonical FROM ne WHERE alias IS NOT NULL AND alias <> '' GROUP BY doc_id, alias)"""


def _norm(spark, d) -> DataFrame:
    return table(spark, d, "definitions_normalized").dropDuplicates(["norm_id"])


@query(f"WITH {ALIAS_SQL} SELECT doc_id, alias, canonical FROM am")
def alias_map(spark, d):
    return definitions.alias_map(_norm(spark, d))


_CANON = " ".join(f"WHEN low = '{k}' THEN '{v}'" for k, v in L.AGENT_CANON.items())
BASE_SQL = rf"CASE WHEN t = '' THEN 'Operatore' {_CANON} WHEN low IN ({', '.join(map(_q, L.AGENT_BANNED))}) THEN 'Operatore' ELSE upper(left(t, 1)) || substr(t, 2) END"


@query(f"""WITH {ALIAS_SQL}, a AS (SELECT DISTINCT doc_id, agent FROM (SELECT doc_id, unnest(allowed_agents) AS agent FROM prompt_blocks)), b AS (SELECT doc_id, agent, {strip_sql("coalesce(agent, '')")} AS t, {squeeze_sql("lower(coalesce(agent, ''))")} AS low FROM a),
c AS (SELECT doc_id, agent, {BASE_SQL} AS base FROM b) SELECT c.doc_id, agent, coalesce(canonical, base) AS grounded FROM c LEFT JOIN am ON am.doc_id = c.doc_id AND am.alias = lower(base)""")
def ground_agents(spark, d):
    a = table(spark, d, "prompt_blocks").select("doc_id", F.explode("allowed_agents").alias("agent")).distinct()
    return definitions.ground(a, definitions.alias_map(_norm(spark, d))).select("doc_id", "agent", "grounded")


@query()
def normalized_agents(spark, d):
    a = table(spark, d, "prompt_blocks").select(F.explode("allowed_agents").alias("agent")).where("agent is not null").distinct()
    return a.select("agent", T.normalize_agent(F.col("agent")).alias("normalized"))


def _plain_sql(c: str) -> str:
    return squeeze_sql(rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


@query(rf"""WITH b AS (SELECT agent_id, {squeeze_sql('canonical_agent')} AS base FROM agent_registry), t AS (SELECT agent_id, base, {_plain_sql('base')} AS plain, list_filter(string_split({_plain_sql('lower(base)')}, ' '), lambda x: length(x) >= 3)[1:6] AS toks FROM b),
q AS (SELECT agent_id, list_filter([base, lower(base), plain] || toks || list_transform(generate_series(1, len(toks) - 1), lambda i: toks[i] || ' ' || toks[i + 1]), lambda x: x <> '') AS qs FROM t),
u AS (SELECT agent_id, i, qs[i] AS subquery FROM q, unnest(generate_series(1, len(qs))) AS g(i) QUALIFY row_number() OVER (PARTITION BY agent_id, qs[i] ORDER BY i) = 1)
SELECT agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY i) - 1 AS pos, subquery FROM u QUALIFY pos < 6""")
def agent_queries(spark, d):
    a = table(spark, d, "agent_registry")
    return a.select("agent_id", F.posexplode(T.agent_queries(F.col("canonical_agent"))).alias("pos", "subquery"))


@query(f"SELECT DISTINCT section_title, section_title || {_q(L.SUPPORT_WORDS)} AS support FROM diagram_procedures WHERE section_title IS NOT NULL")
def support_queries(spark, d):
    return table(spark, d, "diagram_procedures").where("section_title is not null").select("section_title", T.support_query(F.col("section_title")).alias("support")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payloads(spark, d):
    e = table(spark, d, "events").withColumn("raw", F.concat(F.lit("Risposta: "), "props", F.lit(" fine")))
    return e.select("event_id", F.get_json_object(T.json_object(F.col("raw")), "$.k").cast("bigint").alias("k"))


# ---- process graphs ------------------------------------------------------------------------------------------------


def _steps(spark, d) -> DataFrame:
    """Steps of the recorded procedures: checks are gateways, the two steps behind one are its arms."""
    r = table(spark, d, "procedure_records").dropDuplicates(["procedure_id"]).select("procedure_id", F.posexplode("steps").alias("step_idx", "s")).where("s is not null")
    w = Window.partitionBy("procedure_id").orderBy("step_idx")
    gate = F.col("s").rlike("^(Verifica|Controlla) ")
    r = r.withColumn("gate", gate).withColumn("p1", F.lag("gate", 1, False).over(w)).withColumn("p2", F.lag("gate", 2, False).over(w))
    meta = F.when(F.col("p1"), "branch=sì").when(F.col("p2"), "branch=No").otherwise("")
    return r.select("procedure_id", "step_idx", (F.col("step_idx") + 1).cast("string").alias("id"), F.when(F.col("gate"), "gateway_exclusive").otherwise("activity_task").alias("type"), F.lit(L.DEFAULT_AGENT).alias("agent"), F.col("s").alias("description_synthetic"), meta.alias("meta"))


STEPS_SQL = r"""pr AS (SELECT DISTINCT procedure_id, steps FROM procedure_records WHERE steps IS NOT NULL),
s0 AS (SELECT procedure_id, i - 1 AS pos, steps[i] AS s FROM pr, unnest(generate_series(1, len(steps))) AS t(i) WHERE steps[i] IS NOT NULL),
s1 AS (SELECT *, regexp_matches(s, '^(Verifica|Controlla) ') AS gate FROM s0),
s2 AS (SELECT *, row_number() OVER w - 1 AS step_idx, CASE WHEN lag(gate, 1, false) OVER w THEN 'SI' WHEN lag(gate, 2, false) OVER w THEN 'NO' ELSE '' END AS arm, coalesce(lead(CAST(pos + 1 AS VARCHAR), 1) OVER w, 'end') AS next FROM s1 WINDOW w AS (PARTITION BY procedure_id ORDER BY pos)),
s3 AS (SELECT *, min(CASE WHEN arm = '' THEN step_idx END) OVER (PARTITION BY procedure_id ORDER BY step_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM s2),
ga AS (SELECT g.procedure_id, g.step_idx, a.step_idx AS j, CAST(a.pos + 1 AS VARCHAR) AS target, a.arm, row_number() OVER (PARTITION BY g.procedure_id, g.step_idx, a.arm ORDER BY a.step_idx) AS k FROM s3 g JOIN s3 a ON g.procedure_id = a.procedure_id AND g.gate AND a.arm <> '' AND a.step_idx > g.step_idx AND a.step_idx < coalesce(g.stop, 1000000000)),
lk AS (SELECT s3.procedure_id, s3.step_idx, CAST(pos + 1 AS VARCHAR) AS id, CASE WHEN gate THEN 'gateway_exclusive' ELSE 'activity_task' END AS type, row_number() OVER (PARTITION BY s3.procedure_id, s3.step_idx ORDER BY j) - 1 AS branch_no, CASE WHEN arm2 IS NULL THEN '' WHEN k = 1 THEN arm2 ELSE arm2 || ' (' || k || ')' END AS label, coalesce(target, next) AS target
 FROM s3 LEFT JOIN (SELECT procedure_id, step_idx, j, target, arm AS arm2, k FROM ga) g USING (procedure_id, step_idx)),
ed AS (SELECT DISTINCT procedure_id, src, tgt, label FROM (SELECT procedure_id, 's_' || id AS src, CASE WHEN target = 'end' THEN 'end' ELSE 's_' || target END AS tgt, label FROM lk UNION ALL SELECT procedure_id, 'start', 's_' || min_by(id, step_idx), '' FROM lk GROUP BY procedure_id) WHERE src <> tgt)"""


@query(f"WITH {STEPS_SQL} SELECT procedure_id, step_idx, id, type, branch_no, label, target FROM lk")
def step_links(spark, d):
    return graph.link_steps(_steps(spark, d))


def _edges(spark, d) -> DataFrame:
    s = _steps(spark, d)
    return graph.edges(s, graph.link_steps(s))


@query(f"WITH {STEPS_SQL} SELECT procedure_id, src, tgt, label FROM ed")
def step_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {STEPS_SQL} SELECT procedure_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT procedure_id, src AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT procedure_id, tgt, 0, 1 FROM ed) GROUP BY ALL")
def step_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query()
def limited_edges(spark, d):
    return graph.limited_edges(_edges(spark, d))


def _proc_titles(spark, d) -> DataFrame:
    return table(spark, d, "procedure_records").groupBy("procedure_id").agg(F.min("section_title").alias("title"))


@query()
def lane_diagrams(spark, d):
    return graph.lane_diagram(_steps(spark, d), graph.limited_edges(_edges(spark, d)), _proc_titles(spark, d))


@query()
def dot_diagrams(spark, d):
    return graph.dot_source(_steps(spark, d), _edges(spark, d), _proc_titles(spark, d), lanes=True)


_PART = lambda k: rf"lower(printf('%02x', CAST('0x' || substr(md5(canonical_agent), {k}, 2) AS INTEGER) % 100 + 155))"


@query(f"WITH r AS (SELECT canonical_agent, agent_kind, dense_rank() OVER (PARTITION BY agent_kind ORDER BY canonical_agent) - 1 AS rank FROM agent_registry) SELECT canonical_agent, rank, CASE WHEN rank < 10 THEN [{', '.join(map(_q, L.PALETTE))}][rank + 1] ELSE '#' || {_PART(1)} || {_PART(3)} || {_PART(5)} END AS colour FROM r")
def agent_colours(spark, d):
    r = F.dense_rank().over(Window.partitionBy("agent_kind").orderBy("canonical_agent")) - 1
    return table(spark, d, "agent_registry").withColumn("rank", r).select("canonical_agent", "rank", T.agent_colour(F.col("rank"), F.col("canonical_agent")).alias("colour"))


def _wrap_sql(c: str, width: int) -> str:
    return rf"list_reduce(list_filter(string_split({c}, ' '), lambda w: w <> ''), lambda a, w: CASE WHEN length(list_last(string_split(a, '\n'))) + 1 + length(w) <= {width} THEN a || ' ' || w ELSE a || '\n' || w END)"


@query(f"WITH {STEPS_SQL} SELECT procedure_id, CAST(pos + 1 AS VARCHAR) AS id, CASE WHEN {squeeze_sql('s')} = '' THEN '' ELSE {_wrap_sql(squeeze_sql('s'), 25)} END AS label FROM s0")
def wrapped_labels(spark, d):
    s = _steps(spark, d)
    return s.select("procedure_id", "id", T.wrap(F.col("description_synthetic"), 25).alias("label"))


@query(rf"""WITH {STEPS_SQL}, w AS (SELECT procedure_id, CAST(pos + 1 AS VARCHAR) AS id, CASE WHEN {squeeze_sql('s')} = '' THEN '' ELSE {_wrap_sql(squeeze_sql('s'), 25)} END AS label FROM s0), n AS (SELECT *, CASE WHEN label = '' THEN 1 ELSE len(string_split(label, '\n')) END AS lines FROM w)
SELECT procedure_id, id, lines, printf('%.2f', greatest(1.0::DOUBLE, least(2.8::DOUBLE, 1.0::DOUBLE + (lines - 1) * 0.22::DOUBLE))) AS diameter, CAST(trunc(greatest(90.0::DOUBLE, least(220.0::DOUBLE, 28 + 7.2::DOUBLE * length(id)))) AS INT) AS header FROM n""")
def label_sizes(spark, d):
    s = _steps(spark, d).select("procedure_id", "id", context.label_lines(T.wrap(F.col("description_synthetic"), 25)).alias("lines"))
    return s.select("procedure_id", "id", "lines", context.diameter(F.col("lines")).alias("diameter"), context.lane_header_px(F.col("id")).alias("header"))


@query("""WITH r AS (SELECT DISTINCT procedure_id, doc_id, section_title FROM procedure_records WHERE section_title IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_title ORDER BY procedure_id) AS k FROM r)
SELECT procedure_id, doc_id, CASE WHEN k > 1 THEN section_title || ' (' || k || ')' ELSE section_title END AS label FROM k""")
def numbered_titles(spark, d):
    r = table(spark, d, "procedure_records").where("section_title is not null").select("procedure_id", "doc_id", "section_title").distinct()
    return context.unique_labels(r, "doc_id", "section_title", "procedure_id").select("procedure_id", "doc_id", "label")


@query(rf"""WITH n AS (SELECT procedure_id AS pos, left(regexp_replace(regexp_replace(regexp_replace(coalesce(min(section_title), ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '{WS}+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 100) AS file FROM procedure_records GROUP BY procedure_id),
k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS k FROM n) SELECT pos, CASE WHEN k > 0 THEN file || '_' || k ELSE file END AS file FROM k""")
def unique_file_names(spark, d):
    n = table(spark, d, "procedure_records").groupBy(F.col("procedure_id").alias("pos")).agg(F.coalesce(F.min("section_title"), F.lit("")).alias("name"))
    return readers.unique_names(n).select("pos", "file")


@query(r"""WITH p AS (SELECT DISTINCT procedure_id, steps FROM procedure_records WHERE steps IS NOT NULL) SELECT procedure_id, CAST(row_number() OVER (PARTITION BY procedure_id ORDER BY i) AS VARCHAR) AS point_label, steps[i] AS original_text FROM p, unnest(generate_series(1, len(steps))) AS t(i) WHERE steps[i] IS NOT NULL""")
def step_points(spark, d):
    s = _steps(spark, d)
    listed = pipeline.with_branches(s, graph.link_steps(s)).groupBy("procedure_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step_idx", "step"))), lambda x: x.step).alias("steps"))
    return listed.select("procedure_id", F.explode(pipeline.points(F.col("steps"))).alias("p")).select("procedure_id", "p.point_label", "p.original_text")


# ---- evaluation ----------------------------------------------------------------------------------------------------


def _strong_sql(c: str) -> str:
    n = rf"regexp_replace(regexp_replace(regexp_replace(replace(replace({c}, chr(9), ' '), chr(13), chr(10)), '[ \x{{00A0}}]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return squeeze_sql(rf"regexp_replace(lower({strip_sql(n)}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


def _agents(spark, d) -> tuple[DataFrame, DataFrame]:
    """Agents of the normalised definitions as gold, typed agents of the prompts as predictions, by document."""
    g = _norm(spark, d).where("is_agent and term is not null").select(F.col("doc_id").alias("key"), T.normalize_strong(F.col("term")).alias("item")).where("item <> ''")
    p = table(spark, d, "prompt_blocks").select(F.col("doc_id").alias("key"), F.explode("allowed_agents").alias("a")).where("a is not null").select("key", T.normalize_strong(F.col("a")).alias("item")).where("item <> ''")
    return g, p


AGENTS_SQL = rf"""g AS (SELECT DISTINCT doc_id AS key, {_strong_sql('term')} AS item FROM definitions_normalized WHERE is_agent AND term IS NOT NULL),
p AS (SELECT DISTINCT key, {_strong_sql('a')} AS item FROM (SELECT doc_id AS key, unnest(allowed_agents) AS a FROM prompt_blocks) WHERE a IS NOT NULL),
j AS (SELECT coalesce(g.key, p.key) AS key, count(*) FILTER (WHERE g.item IS NOT NULL AND p.item IS NOT NULL) AS tp, count(*) FILTER (WHERE g.item IS NULL) AS fp, count(*) FILTER (WHERE p.item IS NULL) AS fn
 FROM (SELECT * FROM g WHERE item <> '') g FULL OUTER JOIN (SELECT * FROM p WHERE item <> '') p ON g.key = p.key AND g.item = p.item GROUP BY 1),
m AS (SELECT key, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END AS recall, tp / (tp + fp + fn)::DOUBLE AS jaccard FROM j)"""


@query(f"WITH {AGENTS_SQL} SELECT key, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END, 6) AS f1, round(jaccard, 6) AS jaccard FROM m")
def set_prf(spark, d):
    g, p = _agents(spark, d)
    m = evaluation.set_prf(g, p, ["key"])
    return m.select("key", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


@query(f"WITH {AGENTS_SQL} SELECT metric, round(avg(value), 6) AS mean, count(*) AS documents FROM (SELECT key, unnest(['precision', 'recall', 'jaccard']) AS metric, unnest([precision, recall, jaccard]) AS value FROM m) GROUP BY metric")
def macro_average(spark, d):
    g, p = _agents(spark, d)
    m = evaluation.set_prf(g, p, ["key"]).select("key", F.explode(F.create_map(F.lit("precision"), "precision", F.lit("recall"), "recall", F.lit("jaccard"), "jaccard")).alias("metric", "value"))
    return evaluation.macro_average(m, ["metric"]).withColumn("mean", F.round("mean", 6))


def _flags(spark, d) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "diagram_procedures").where("original_text_full is not null").dropDuplicates(["procedure_id"])
    gold = p.select("procedure_id", (S.procedural_score(F.col("original_text_full"), "rag") >= 0.2).alias("flag"))
    pred = p.where("status is not null").select("procedure_id", (F.lower("status") == "complete").alias("flag"))
    return gold, pred


@query(f"""WITH q AS (SELECT DISTINCT procedure_id, original_text_full AS text, status FROM diagram_procedures WHERE original_text_full IS NOT NULL), s AS (SELECT procedure_id, status, {_T} AS t FROM q),
f AS (SELECT {PROC_RAG_SQL} >= 0.2::DOUBLE AS g, coalesce(lower(status) = 'complete', false) AS p FROM s), c AS (SELECT count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE NOT g AND NOT p) AS tn, count(*) FILTER (WHERE g AND NOT p) AS fn FROM f)
SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy FROM c""")
def flag_confusion(spark, d):
    c = evaluation.flag_confusion(*_flags(spark, d), ["procedure_id"])
    return c.select("tp", "fp", "tn", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "accuracy")])


def _title_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    """Section titles of the procedures as gold, the best-scored title lines as predictions, by document."""
    g = table(spark, d, "procedure_records").dropDuplicates(["procedure_id"]).where("section_title is not null").select(F.col("doc_id").alias("key"), F.col("section_title").alias("text"), "procedure_id")
    g = g.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("procedure_id")) - 1).drop("procedure_id")
    p = _titles(spark, d).select(F.col("doc_id").alias("key"), F.col("title").alias("text"), "start_line").withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("start_line")) - 1).drop("start_line")
    return g, p


def _match_sql(least: float) -> str:
    """Best token F1 of every gold item of ``g``, the first prediction of ``p`` on ties; a prediction serves once."""
    return f"""gt AS (SELECT key, idx AS gi, list_distinct(list_filter(string_split({_strong_sql('text')}, ' '), lambda x: x <> '')) AS gt FROM g), pt AS (SELECT key, idx AS pi, list_distinct(list_filter(string_split({_strong_sql('text')}, ' '), lambda x: x <> '')) AS pt FROM p),
mp AS (SELECT gt.key, gi, pi, 2 * len(list_intersect(gt, pt)) / (len(gt) + len(pt))::DOUBLE AS s FROM gt JOIN pt USING (key) WHERE len(list_intersect(gt, pt)) > 0),
be AS (SELECT * FROM mp QUALIFY row_number() OVER (PARTITION BY key, gi ORDER BY s DESC, pi) = 1), us AS (SELECT key, pi, min(gi) AS gi FROM be WHERE s >= {least}::DOUBLE GROUP BY key, pi), nm AS (SELECT key, count(*) AS matched FROM us GROUP BY key),
ba AS (SELECT coalesce(a.key, b.key) AS key, coalesce(golds, 0) AS golds, coalesce(preds, 0) AS preds, coalesce(matched, 0) AS matched FROM (SELECT key, count(*) AS golds FROM gt GROUP BY key) a FULL OUTER JOIN (SELECT key, count(*) AS preds FROM pt GROUP BY key) b ON a.key = b.key LEFT JOIN nm ON nm.key = coalesce(a.key, b.key)),
sc AS (SELECT *, CASE WHEN preds > 0 THEN matched / preds::DOUBLE ELSE 0 END AS p, CASE WHEN golds > 0 THEN matched / golds::DOUBLE ELSE 0 END AS r FROM ba)"""


_SCORES = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"


@query(f"""WITH {TREE_SQL}, g0 AS (SELECT DISTINCT procedure_id, doc_id, section_title FROM procedure_records WHERE section_title IS NOT NULL), g AS (SELECT doc_id AS key, section_title AS text, row_number() OVER (PARTITION BY doc_id ORDER BY procedure_id) - 1 AS idx FROM g0),
p AS (SELECT doc_id AS key, title AS text, idx FROM ti), {_match_sql(0.72)} SELECT key, golds, preds, matched, {_SCORES} FROM sc""")
def title_token_match(spark, d):
    g, p = _title_lists(spark, d)
    m = evaluation.best_token_match(g, p, "key")
    return m.select("key", "golds", "preds", "matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query()
def title_assignment(spark, d):
    g, p = _title_lists(spark, d)
    return evaluation.match_lists(g, p, True, 0.85)


@query()
def title_metrics(spark, d):
    g, p = _title_lists(spark, d)
    return evaluation.block_metrics(g, p, evaluation.match_lists(g, p, True, 0.85))


_GRAMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+')"


@query(f"""WITH t AS (SELECT task, item_id, {_GRAMS} AS ws FROM eval_items), gr AS (SELECT task, item_id, unnest(ws || list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM t),
tf AS (SELECT task, item_id, g, count(*) AS tf FROM gr GROUP BY ALL), n AS (SELECT task, count(DISTINCT item_id) AS n FROM t GROUP BY task), df AS (SELECT task, g, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT task, item_id, g, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (task, g) JOIN n USING (task)), nr AS (SELECT task, item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), v AS (SELECT task, item_id, g, w / norm AS w FROM w JOIN nr USING (task, item_id))
SELECT a.task, a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 5) AS cosine FROM v a JOIN v b ON a.task = b.task AND a.g = b.g AND a.item_id < b.item_id GROUP BY ALL""")
def tfidf_words(spark, d):
    w = evaluation.tfidf(table(spark, d, "eval_items"), "task", "item_id", evaluation.word_grams(F.col("text")))
    return evaluation.cosine_pairs(w, "task", "item_id").withColumn("cosine", F.round("cosine", 5))


@query(rf"""WITH t AS (SELECT task, item_id, unnest(list_filter(string_split(lower({squeeze_sql('text')}), ' '), lambda w: w <> '')) AS w FROM eval_items), p AS (SELECT task, item_id, ' ' || w || ' ' AS p FROM t),
gr AS (SELECT task, item_id, substr(p, i, n) AS g FROM p, unnest([3, 4, 5]) AS x(n), unnest(generate_series(1, greatest(length(p) - n + 1, 0))) AS y(i)),
tf AS (SELECT task, item_id, g, count(*) AS tf FROM gr GROUP BY ALL), n AS (SELECT task, count(DISTINCT item_id) AS n FROM eval_items GROUP BY task), df AS (SELECT task, g, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT task, item_id, g, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (task, g) JOIN n USING (task)), nr AS (SELECT task, item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), v AS (SELECT task, item_id, g, w / norm AS w FROM w JOIN nr USING (task, item_id))
SELECT a.task, a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 5) AS cosine FROM v a JOIN v b ON a.task = b.task AND a.g = b.g AND a.item_id < b.item_id GROUP BY ALL""")
def tfidf_chars(spark, d):
    w = evaluation.tfidf(table(spark, d, "eval_items"), "task", "item_id", evaluation.char_grams(F.col("text")))
    return evaluation.cosine_pairs(w, "task", "item_id").withColumn("cosine", F.round("cosine", 5))


@query(f"""WITH t AS (SELECT procedure_id, list_distinct(list_filter(string_split({_strong_sql('section_title')}, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split({_strong_sql('section_path')}, ' '), lambda x: x <> '')) AS b
FROM (SELECT DISTINCT procedure_id, section_title, section_path FROM procedure_records WHERE section_title IS NOT NULL AND section_path IS NOT NULL)) SELECT procedure_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE ELSE 0 END, 6) AS containment FROM t""")
def title_containment(spark, d):
    r = table(spark, d, "procedure_records").where("section_title is not null and section_path is not null").select("procedure_id", "section_title", "section_path").distinct()
    return r.select("procedure_id", F.round(evaluation.containment(T.tokens(F.col("section_title")), T.tokens(F.col("section_path"))), 6).alias("containment"))


@query(rf"""WITH t AS (SELECT procedure_id, list_distinct(list_filter(string_split({_strong_sql('section_title')}, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split({_strong_sql('section_path')}, ' '), lambda x: x <> '')) AS b
FROM (SELECT DISTINCT procedure_id, section_title, section_path FROM procedure_records WHERE section_title IS NOT NULL AND section_path IS NOT NULL)), n AS (SELECT procedure_id, len(a) AS a, len(b) AS b, len(list_intersect(a, b)) AS n FROM t)
SELECT procedure_id, round(CASE WHEN a = 0 AND b = 0 THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE 2 * (n / b::DOUBLE) * (n / a::DOUBLE) / (n / b::DOUBLE + n / a::DOUBLE) END, 6) AS f1 FROM n""")
def title_f1(spark, d):
    r = table(spark, d, "procedure_records").where("section_title is not null and section_path is not null").select("procedure_id", "section_title", "section_path").distinct()
    return r.select("procedure_id", F.round(evaluation.token_f1(T.tokens(F.col("section_title")), T.tokens(F.col("section_path"))), 6).alias("f1"))


@query(rf"""WITH t AS (SELECT procedure_id, len(list_filter(string_split({_strong_sql('section_title')}, ' '), lambda x: x <> '')) AS a, len(list_filter(string_split({_strong_sql('section_path')}, ' '), lambda x: x <> '')) AS b
FROM (SELECT DISTINCT procedure_id, section_title, section_path FROM procedure_records WHERE section_title IS NOT NULL AND section_path IS NOT NULL)) SELECT procedure_id, round(power(least(greatest(a, 1), greatest(b, 1)) / greatest(a, b, 1)::DOUBLE, 0.6::DOUBLE), 6) AS damping FROM t""")
def title_damping(spark, d):
    r = table(spark, d, "procedure_records").where("section_title is not null and section_path is not null").select("procedure_id", "section_title", "section_path").distinct()
    return r.select("procedure_id", F.round(evaluation.length_penalty(T.tokens(F.col("section_title")), T.tokens(F.col("section_path"))), 6).alias("damping"))


_SPACED = rf"regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(9), ' '), chr(13), chr(10)), '[ \x{{00A0}}]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE left(t, 177) || '...' END AS excerpt FROM (SELECT doc_id, {squeeze_sql(_SPACED)} AS t FROM documents WHERE text IS NOT NULL)")
def excerpts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query(rf"""WITH s AS (SELECT DISTINCT doc_id, variant AS system, CASE variant WHEN 'rag' THEN 1 WHEN 'no_rag_guided' THEN 2 WHEN 'no_rag_only' THEN 3 END AS n, {_strong_sql('term')} AS item FROM definitions_raw WHERE variant IN ('rag', 'no_rag_guided', 'no_rag_only') AND term IS NOT NULL),
t AS (SELECT * FROM s WHERE item <> ''), d AS (SELECT DISTINCT doc_id, system, n FROM t), pa AS (SELECT a.doc_id, a.system AS x, b.system AS y FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.n < b.n),
j AS (SELECT pa.doc_id, x, y, item, max(CASE WHEN t.system = x THEN 1 ELSE 0 END) AS ix, max(CASE WHEN t.system = y THEN 1 ELSE 0 END) AS iy FROM pa JOIN t ON t.doc_id = pa.doc_id AND t.system IN (x, y) GROUP BY ALL),
m AS (SELECT doc_id, x, y, sum(ix * iy) AS tp, sum(iy * (1 - ix)) AS fp, sum(ix * (1 - iy)) AS fn FROM j GROUP BY ALL), v AS (SELECT x, y, unnest(['precision', 'recall', 'jaccard']) AS metric, unnest([CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, tp / (tp + fp + fn)::DOUBLE]) AS value FROM m)
SELECT 'pairwise' AS kind, x AS first, y AS second, 'agents' AS block, metric, round(avg(value), 6) AS mean, count(*) AS documents FROM v GROUP BY ALL""")
def evaluation_means(spark, d):
    """The evaluation over the recorded extractors as systems: terms as agents, no lists."""
    t = table(spark, d, "definitions_raw").where(F.col("variant").isin(*evaluate.SYSTEMS) & F.col("term").isNotNull())
    a = t.select(F.col("doc_id").alias("doc"), F.col("variant").alias("system"), T.normalize_strong(F.col("term")).alias("agent")).where("agent <> ''").distinct()
    none = spark.createDataFrame([], "doc string, system string, idx int, text string")
    m = evaluate.aggregate(evaluate.metrics({"titles": none, "procedures": none, "agents": a}))
    return m.where("metric <> 'f1'").withColumn("mean", F.round("mean", 6))


@query("""WITH g AS (SELECT DISTINCT agent_id AS group_id, lower(alias) AS alias FROM (SELECT agent_id, canonical_agent AS alias FROM agent_registry UNION ALL SELECT agent_id, acronym FROM agent_registry) WHERE alias IS NOT NULL),
c AS (SELECT group_id, min(struct_pack(n := length(alias), a := alias)).a AS canonical FROM g GROUP BY group_id) SELECT alias, max_by(canonical, group_id) AS canonical FROM g JOIN c USING (group_id) GROUP BY alias""")
def gold_agent_names(spark, d):
    r = table(spark, d, "agent_registry")
    a = r.select(F.col("agent_id").alias("group_id"), F.explode(F.array("canonical_agent", "acronym")).alias("a")).where("a is not null").select("group_id", F.lower("a").alias("alias")).distinct()
    return evaluation.canonical_agents(a)


@query("""WITH s AS (SELECT DISTINCT doc_id, variant AS system, CASE variant WHEN 'rag' THEN 1 WHEN 'no_rag_guided' THEN 2 WHEN 'no_rag_only' THEN 3 END AS n FROM definitions_raw WHERE variant IN ('rag', 'no_rag_guided', 'no_rag_only'))
SELECT a.doc_id, a.system AS first, b.system AS second FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.n < b.n""")
def system_pairs(spark, d):
    r = table(spark, d, "definitions_raw").where(F.col("variant").isin("rag", "no_rag_guided", "no_rag_only")).select("doc_id", F.col("variant").alias("system"))
    return evaluation.pair_systems(r)


@query("""WITH t AS (SELECT DISTINCT doc_id, def_id, regexp_replace(term, '^\\s+|\\s+$', '', 'g') AS t, regexp_replace(definition, '^\\s+|\\s+$', '', 'g') AS d FROM definitions_raw),
v AS (SELECT doc_id, def_id, lower(t) AS alias, CASE WHEN regexp_matches(t, '^[A-Z0-9]{2,12}$') AND length(d) >= 8 THEN t || ' (' || regexp_replace(left(d, 80), '\\.+$', '') || ')'
 WHEN lower(t) IN ('operatore', 'richiedente', 'utente', 'cittadino') THEN regexp_replace(regexp_replace(left(d, 80), '\\.+$', ''), '^\\s+|\\s+$', '', 'g') END AS canonical FROM t WHERE t <> '' AND d <> '')
SELECT doc_id, alias, max_by(canonical, def_id) AS canonical FROM v WHERE canonical IS NOT NULL GROUP BY ALL""".replace("\\\\", "\\"))
def acronym_map(spark, d):
    return definitions.acronym_map(_defs(spark, d))


_LIST = "CASE WHEN len(list_filter(coalesce({0}, []), lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_transform(list_filter({0}, lambda x: x IS NOT NULL)[1:{1}], lambda x: '- ' || x), chr(10)) ELSE '-' END"


@query(f"""SELECT DISTINCT procedure_id, 'DOC_ID: ' || coalesce(nullif(doc_id, ''), '-') || chr(10) || 'SECTION_TITLE: ' || coalesce(nullif(section_title, ''), '-') || chr(10) || 'PATH: ' || coalesce(nullif(section_path, ''), '-') || chr(10) || 'STEPS:' || chr(10) || {_LIST.format('steps', 20)} || chr(10) || 'NOTES:' || chr(10) || {_LIST.format('notes', 10)} AS summary FROM procedure_records""")
def procedure_summaries(spark, d):
    r = table(spark, d, "procedure_records")
    return r.select("procedure_id", context.procedure_summary(*map(F.col, ("doc_id", "section_title", "section_path", "steps", "notes"))).alias("summary")).distinct()


@query()
def agent_support(spark, d):
    """Definition blocks for the agents that the recorded procedures' texts name."""
    p = table(spark, d, "diagram_procedures").where("original_text_full is not null").dropDuplicates(["procedure_id"])
    defs = chunks.definition_chunks(_defs(spark, d)).select("doc_id", "id", "term", "text")
    return context.definition_support(p.select("doc_id", F.col("procedure_id").alias("section_id"), F.col("original_text_full").alias("text")), definitions.allowed_agents(_defs(spark, d)), defs)


@query()
def context_blocks(spark, d):
    """Context of every procedure: its agents' definitions, then its document's passages."""
    p = table(spark, d, "diagram_procedures").where("original_text_full is not null").dropDuplicates(["procedure_id"]).select("doc_id", F.col("procedure_id").alias("section_id"), F.col("original_text_full").alias("text"))
    defs = chunks.definition_chunks(_defs(spark, d)).select("doc_id", "id", "term", "text")
    blocks = context.definition_support(p, definitions.allowed_agents(_defs(spark, d)), defs).select("section_id", F.col("place").alias("pos"), "id", "text")
    title = table(spark, d, "diagram_procedures").groupBy(F.col("procedure_id").alias("query_id")).agg(F.first("section_title", True).alias("title"))
    q = p.select(F.col("section_id").alias("query_id"), "doc_id").join(title, "query_id").select("query_id", "doc_id", retrieval.hashing_embedder(T.support_query(F.coalesce("title", F.lit("")))).alias("qvec"))
    near = lambda x, k: retrieval.knn(q, x.select("doc_id", "id", retrieval.hashing_embedder(F.col("text")).alias("vec")), k, on=["doc_id"]).join(x.drop("doc_id"), "id").withColumn("section_id", F.col("query_id")).withColumn("pos", F.col("rank"))
    hits = near(defs, 8).select("section_id", "pos", "id", "term", "text")
    return context.assemble(blocks, hits, near(chunks.passages(_lines(spark, d)).select("doc_id", "id", "text"), 12).select("section_id", "pos", "id", "text"))


@query()
def canonical_predictions(spark, d):
    """Typed agents of the prompts brought to the registry's names by exact alias or TF-IDF."""
    r = table(spark, d, "agent_registry")
    al = r.select(F.col("agent_id").alias("group_id"), F.explode(F.array("canonical_agent", "acronym")).alias("a")).where("a is not null").select("group_id", T.normalize_agent(F.col("a")).alias("alias")).distinct()
    a = table(spark, d, "prompt_blocks").select(F.col("doc_id").alias("key"), F.explode("allowed_agents").alias("agent")).where("agent is not null")
    return evaluation.canonicalize_agents(a, al)


@query(rf"""WITH {STEPS_SQL}, g AS (SELECT procedure_id AS key, pos AS idx, s AS text FROM s0), tx AS (SELECT DISTINCT procedure_id, string_split(original_text_full, chr(10)) AS ls FROM diagram_procedures WHERE original_text_full IS NOT NULL),
p AS (SELECT procedure_id AS key, i AS idx, regexp_replace(ls[i], {_q(L.BULLET)}, '') AS text FROM tx, unnest(generate_series(1, len(ls))) AS t(i) WHERE regexp_matches(ls[i], {_q(L.BULLET)})), {_match_sql(0.6)}
SELECT key, golds, preds, matched, {_SCORES}, CASE WHEN matched > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS agent_accuracy FROM sc""")
def step_scores(spark, d):
    """Recorded steps as gold against the list items of the procedure's own text."""
    g = _steps(spark, d).select(F.col("procedure_id").alias("key"), F.col("step_idx").alias("idx"), F.col("description_synthetic").alias("text"), "agent")
    t = table(spark, d, "diagram_procedures").where("original_text_full is not null").dropDuplicates(["procedure_id"])
    p = t.select(F.col("procedure_id").alias("key"), F.posexplode(F.split("original_text_full", "\n")).alias("idx", "l")).where(S.bullet(F.col("l"))).select("key", "idx", F.regexp_replace("l", S.BULLET, "").alias("text"), F.lit(L.DEFAULT_AGENT).alias("agent"))
    m = evaluation.step_match(g, p, "key", 0.6)
    return m.select("key", "golds", "preds", "matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "agent_accuracy")])


# ---- store and pipelines -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT term AS id, definition AS text, def_id AS pos, variant FROM definitions_raw WHERE regexp_replace(coalesce(term, ''), '^\\s+|\\s+$', '', 'g') <> '' AND regexp_replace(coalesce(definition, ''), '^\\s+|\\s+$', '', 'g') <> '')
SELECT id, min_by(text, pos) AS text, min(pos) AS pos FROM r WHERE variant = 'rag' AND id NOT IN (SELECT id FROM r WHERE variant = 'gold') GROUP BY id""".replace("\\\\", "\\"))
def store_upsert(spark, d):
    r = table(spark, d, "definitions_raw").select(F.col("term").alias("id"), F.col("definition").alias("text"), F.col("def_id").alias("pos"), "variant")
    have = r.where("variant = 'gold'").where(T.strip(F.coalesce("text", F.lit(""))) != "").select("id").distinct()
    return store.new_rows(r.where("variant = 'rag'").drop("variant"), have).select("id", "text", "pos")


@query()
def diagram_counts(spark, d):
    """Outcome of drawing the recorded procedures in three layouts."""
    s = _steps(spark, d)
    listed = pipeline.with_branches(s, graph.link_steps(s)).groupBy("procedure_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step_idx", "step"))), lambda x: x.step).alias("steps"))
    r = table(spark, d, "procedure_records").groupBy("procedure_id").agg(F.min("doc_id").alias("doc_id"), F.min("section_title").alias("subsection_title"))
    return diagrams.counts(diagrams.three_layouts(r.join(listed, "procedure_id", "left")))


def _pipeline(variant: str):
    def f(spark, d):
        return pipeline.run(table(spark, d, "documents"), variant)["stats"]

    f.__name__ = f"pipeline_{variant}"
    return query()(f)


for _v in ("rag", "guided", "only"):
    _pipeline(_v)

"""Result files with exact names: written by the tasks, each file once, and read back as tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = {"rag": "", "guided": "_NO_RAG_GUIDED", "only": "_NO_RAG_ONLY"}
RESULT = {"rag": "rag", "guided": "no_rag_guided", "only": "no_rag_only"}


def as_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def pretty(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2)


def write_files(files: DataFrame, root: str, indent: bool = True) -> DataFrame:
    """Writes ``files(path, content)`` below ``root`` (a local path or a URI that all executors reach), JSON indented.

    Returns ``path, size, error``, one row a file; a file that can't be written is a row with its error.  A file is
    written beside its place and moved there, so a task that runs again leaves whole files; the last of equal paths
    stays.  Null paths or contents are skipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    data = (pretty(content) if indent and path.endswith(".json") else content).encode()
                    at = f"{base.rstrip('/')}/{path}"
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    aside = f"{at}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(aside) as f:
                        f.write(data)
                    store.move(aside, at)
                    rows.append((path, len(data), None))
                except Exception as e:  # one file, not the job
                    rows.append((path, 0, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "size", "error"])

    whole = files.where("path is not null and content is not null").select("path", "content")
    return whole.mapInPandas(run, "path string, size long, error string")


def document_files(out: dict[str, DataFrame], variant: str) -> DataFrame:
    """Files of a pipeline run, ``path, content``: diagrams, raw and normalised definitions and the result of every
    document; for ``only`` the chunks too."""
    folder = F.concat("doc_id", F.lit(SUFFIX[variant]))
    name = lambda end: F.concat(folder, F.lit("/"), folder, F.lit(end)).alias("path")
    docs = out["stats"].select("doc_id", F.struct(*[c for c in out["stats"].columns if c != "doc_id"]).alias("stats"))

    def listed(table: str, order: str, *drop: str) -> DataFrame:
        t = out[table]
        cols = [c for c in t.columns if c not in ("doc_id", order, *drop)]
        rows = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), as_json(F.struct(order, *cols)).alias("j")))).alias("r"))
        return rows.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x.j), ","), F.lit("]")).alias(table))

    tables = (("outline", "idx"), ("sections", "sec_idx"), ("records", "sec_idx"), ("diagrams", "procedure_id"), ("definitions", "rank"), ("normalized", "norm_id"))
    for table, order in tables:
        docs = docs.join(listed(table, order), "doc_id", "left").withColumn(table, F.coalesce(table, F.lit("[]")))
    parts = [("outline", "outline"), ("sections", "sections"), ("procedures", "records"), ("diagram_procedures", "diagrams"), ("definitions_raw", "definitions"), ("definitions_normalized", "normalized")]
    body = F.concat(F.lit('{"doc_id":'), F.regexp_extract(as_json(F.struct("doc_id")), r"^\{\"doc_id\":(.*)\}$", 1), *[x for k, t in parts for x in (F.lit(f',"{k}":'), F.col(t))], F.lit(',"stats":'), as_json(F.col("stats")), F.lit("}"))
    made = [
        docs.select(name(".diagram_procedures.json"), F.col("diagrams").alias("content")), docs.select(name(".definitions.raw.json"), F.col("definitions").alias("content")),
        docs.select(name(".definitions.normalized.json"), F.col("normalized").alias("content")), docs.select(name(f".{RESULT[variant]}.result.json"), body.alias("content")),
    ]
    if "chunks" in out:
        c = out["chunks"].groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", (F.col("end_char") - F.col("start_char")).alias("len")))).alias("c"))
        made.append(c.select(name(".chunks.json"), as_json(F.col("c")).alias("content")))
    files = made[0]
    for m in made[1:]:
        files = files.unionByName(m)
    return files


RESULT_SCHEMA = (
    "doc_id string, outline array<struct<title:string>>, diagram_procedures array<struct<original_text_full:string,steps:array<struct<agent:string>>>>, "
    "procedures array<struct<text:string,original_text:string>>"
)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """``doc, system, result`` of the result files below ``root``; files that are no JSON object have a null result."""
    f = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.result.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    folder = F.element_at(F.split("path", "/"), -2)
    system = F.regexp_extract("path", r"\.(rag|no_rag_guided|no_rag_only)\.result\.json$", 1)
    f = f.select(F.url_decode(F.regexp_replace(folder, "_NO_RAG_(GUIDED|ONLY)$", "")).alias("doc"), system.alias("system"), F.from_json("value", RESULT_SCHEMA).alias("result"))
    return f.where("system <> ''")


def evaluated_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a result of any system, by name."""
    return read_results(spark, root).where("result is not null").select("doc").distinct().orderBy("doc")

"""Readers and writers: text, DOCX and PDF files, gold annotations, results as JSON, configuration."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrivano.functions import text as T

EXTENSIONS = ("pdf", "docx", "txt")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraph texts of the body, tables apart."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in (body if body is not None else []) if p.tag == f"{W}p")


def pdf_text(data: bytes) -> str:
    """Page texts joined by line feeds; needs an optional PDF library."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def ocr_text(data: bytes, ocr: Callable[[bytes], str]) -> str:
    """Text of a scanned PDF by ``ocr``; the PDF's own text where it fails or finds nothing."""
    try:
        text = ocr(data).strip()
    except Exception:
        text = ""
    return text or pdf_text(data)


def decode(path: str, data: bytes, ocr: Callable[[bytes], str] | None = None) -> tuple[str | None, str | None]:
    """(text, error) of a file by its extension; unknown ones are UTF-8."""
    try:
        ext = path.rsplit(".", 1)[-1].lower()
        if ext == "pdf" and ocr:
            return ocr_text(data, ocr), None
        return (docx_text(data) if ext == "docx" else pdf_text(data) if ext == "pdf" else data.decode("utf-8")), None
    except Exception as e:  # a broken file is a row, not the end of the job
        return None, f"{type(e).__name__}: {e}"[:300]


def read_documents(spark: SparkSession, folder: str, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """``doc_id, text, path, format, error`` of all .pdf, .docx and .txt files under ``folder``.

    ``ocr`` turns a PDF's bytes into text, page by page (a binding of an OCR engine); without it, and where it fails,
    the text that the PDF carries is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    files = files.select("path", ext.alias("format"), "content").where(F.col("format").isin(*EXTENSIONS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decode(p, c, ocr) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "format": b["format"], "text": [g[0] for g in got], "error": [g[1] for g in got]})

    out = files.mapInPandas(run, "path string, format string, text string, error string")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return out.select(stem.alias("doc_id"), "text", "path", "format", "error")


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").schema(schema).json(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("doc"), F.col("value"))


def gold_titles(spark: SparkSession, path: str) -> DataFrame:
    t = _whole(spark, path).select("doc", F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), T.squeeze), lambda x: x != "")).alias("idx", "title"))
    return t


def gold_procedures(spark: SparkSession, path: str) -> DataFrame:
    unquoted = F.regexp_replace(T.strip(F.col("value")), r'^"+|"+$', "")
    return _whole(spark, path).select("doc", F.posexplode(F.filter(F.transform(F.split(unquoted, "-----"), T.strip), lambda x: x != "")).alias("idx", "text"))


def gold_agents(spark: SparkSession, path: str) -> DataFrame:
    """``doc, group_id, alias``: one group per line, aliases between bars, normalised."""
    g = _whole(spark, path).select("doc", F.posexplode(F.split("value", r"\r?\n")).alias("group_id", "l"))
    a = g.select("doc", "group_id", F.explode(F.split("l", r"\|")).alias("a")).withColumn("alias", T.normalize_agent(F.col("a")))
    return a.where("alias <> ''").select("doc", "group_id", "alias").distinct()


def gold_agents_by_procedure(spark: SparkSession, path: str) -> DataFrame:
    b = _whole(spark, path).select("doc", F.posexplode(F.filter(F.split("value", "-----"), lambda x: T.strip(x) != "")).alias("proc_idx", "b"))
    return b.select("doc", "proc_idx", F.explode(F.split("b", r"[\n,]")).alias("a")).select("doc", "proc_idx", T.normalize_agent(F.col("a")).alias("agent")).where("agent <> ''")


def diagram_files(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, path`` of the diagram results below ``root``, by the folder they lie in."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.diagram_procedures.json").load(root)
    return f.select(F.element_at(F.split("path", "/"), -2).alias("doc_id"), "path")


def write_json(df: DataFrame, path: str, by: str = "doc_id") -> None:
    """One folder per key; existing keys are replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(by).json(path)


def unique_names(names: DataFrame, column: str = "name") -> DataFrame:
    """File names made safe; clashes get _1, _2 in order of ``pos``."""
    n = names.withColumn("file", T.file_name(F.col(column)))
    k = F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1
    return n.withColumn("k", k).withColumn("file", F.when(F.col("k") > 0, F.concat("file", F.lit("_"), F.col("k"))).otherwise(F.col("file"))).drop("k")


def definition_line():
    """A definition as a ``term | summary | section | subsection | raw`` text line."""
    return F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("/")) for c in ("term", "summary", "section", "subsection", "raw")])


@dataclass
class Config:
    input_path: str = "input"
    output_path: str = "output"
    delete_existing_store: bool = False
    reset_doc_collections: bool = False
    freeze_global_patterns: bool = True
    use_crossdoc_patterns: bool = True
    use_ocr_for_pdf: bool = False
    poppler_path: str | None = None
    comparison_base_path: str = "eval/comparison_base"
    only_llm_min_chars_per_chunk: int = 2000
    only_llm_max_chars_per_chunk: int = 3000
    only_llm_max_titles_per_chunk: int = 30
    eval_titles_threshold: float = 0.85
    eval_procedures_threshold: float = 0.70


def load_config(text: str) -> Config:
    """``key=value`` lines over the defaults; # starts a comment; true, false and none are values; unknown keys are
    ignored."""
    known = {f.name: f.default for f in fields(Config)}
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if "=" not in line:
            continue
        k, v = (x.strip() for x in line.split("=", 1))
        if k in known:
            low = v.lower()
            kind = type(known[k])
            out[k] = {"true": True, "false": False, "none": None}[low] if low in ("true", "false", "none") else kind(v) if kind in (int, float) else v
    return Config(**out)

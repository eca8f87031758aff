"""Readers and writers: words, Markdown, chunks, code and case tables, contents, structures, hashes, configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

WORDS = "doc_id string, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string, page_height double"
STRUCTURE = "table_id string, pages array<int>, n_rows int, n_cols int, header_rows int, caption_rows int, has_spans boolean, caption string, column_labels array<string>, cells array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>"
CHUNK = (
    "chunk_id string, doc_id string, seq int, type string, heading string, section_path array<string>, breadcrumb string, text string, embed_text string, "
    "page_start int, page_end int, n_tokens int, table_id string, part_index int, part_total int, n_rows int, n_cols int, column_labels array<string>, "
    "form_code string, printed_start int, printed_end int, has_spans boolean, plan_id string, group_number string, plan_year int, effective_date string, "
    "termination_date string, carrier string, market_segment string, states array<string>, source_filename string, source_sha256 string, "
    "pipeline_version string, chunk_config_hash string, created_at string, updated_at string, embed_model string, embed_dim int, embedded_at string, "
    "needs_review boolean, extraction_notes array<string>"
)


def words(spark: SparkSession, path: str) -> DataFrame:
    """Extracted words, from Parquet or JSON lines."""
    return spark.read.schema(WORDS).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(WORDS).parquet(path)


def pdf_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of PDF files, one task for each file; needs the pdfplumber library on the workers."""

    def extract(parts):
        import io

        import pandas as pd
        import pdfplumber

        for p in parts:
            for name, content in zip(p["path"], p["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for page in pdf.pages:
                        rows = [(name, page.page_number, i, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w["size"], w["fontname"], float(page.height)) for i, w in enumerate(page.extract_words(extra_attrs=["size", "fontname"]))]
                        page.flush_cache()
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, WORDS)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's name without its ending) and markdown of whole files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("markdown"))


def chunks(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Chunks from JSON lines; ``doc_id`` overrides the documents' own."""
    df = spark.read.schema(CHUNK).json(path)
    return df.withColumn("doc_id", F.lit(doc_id)).withColumn("chunk_id", T.chunk_id("doc_id", "seq")) if doc_id else df


def parsed_codes(raw: DataFrame) -> DataFrame:
    """code, system, descriptor, synonyms from raw code rows (code, system, descriptor, synonyms, ordinal): codes are
    normalised, blank ones go, the last of equal ones stays, a missing system follows from the code's form."""
    code = T.normalize_code(F.regexp_replace("code", r"^\x{feff}", ""))
    syn = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), r"\|"), T.strip), lambda s: s != "")
    x = raw.select(code.alias("code"), F.lower(F.coalesce(F.nullif(F.trim("system"), F.lit("")), T.classify_code("code"))).alias("system"), F.trim(F.coalesce("descriptor", F.lit(""))).alias("descriptor"), syn.alias("synonyms"), "ordinal").where("code <> ''")
    w = Window.partitionBy("code").orderBy(F.desc("ordinal"))
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "ordinal")


def codes(spark: SparkSession, path: str) -> DataFrame:
    """A code table from CSV; the order of rows is that of the file."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    for c in ("system", "descriptor", "synonyms"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return parsed_codes(raw.withColumn("ordinal", F.monotonically_increasing_id()))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from CSV: rows with a code; synonyms are split at pipes, semicolons, commas and line breaks."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"').where(F.trim(F.coalesce("code", F.lit(""))) != "")
    split = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), r"[|;,\n]"), T.strip), lambda s: s != "")
    return raw.withColumn("synonyms", split)


def structures(spark: SparkSession, path: str) -> DataFrame:
    """Stored table grids, from a JSON array of objects with a table_id."""
    return spark.read.schema(STRUCTURE).json(path, multiLine=True).where("table_id is not null")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files' contents."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_markdown(docs: DataFrame, path: str) -> None:
    """One text file for each document, in folders by doc_id."""
    docs.select("doc_id", "markdown").write.partitionBy("doc_id").mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ---- configuration

# Names that a file must not set.
SECRETS = ("mongodb_uri", "voyage_api_key", "openai_api_key", "anthropic_api_key", "api_key", "password", "token")


@dataclass
class Config:
    source_path: str = ""
    store_path: str = ""
    doc_id: str = ""
    heading_size_ratio: float = 1.12
    bold_is_heading: bool = False
    caps_are_headings: bool = False
    force_heading_patterns: tuple = ()
    target_tokens: int = 650
    max_tokens: int = 900
    overlap_tokens: int = 90
    max_table_tokens: int = 1100
    min_chunk_tokens: int = 25
    plan_id: str = ""
    plan_year: int = 0
    states: tuple = ()
    embed_model: str = "hashing"
    embed_dim: int = 1024
    min_validation_score: float = 0.0
    allow_review: bool = False
    require_full_toc_coverage: bool = False

    def allows(self, verdict: str, score: float, toc_missing: int = 0) -> bool:
        """Whether the gates let a document on."""
        good = verdict == "pass" or (verdict == "review" and self.allow_review)
        return good and score >= self.min_validation_score and not (self.require_full_toc_coverage and toc_missing)


def _coerced(name: str, value: Any) -> Any:
    kind = type(getattr(Config(), name))
    if value is None:
        return getattr(Config(), name)
    if kind is bool:
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if kind is tuple:
        return tuple(value) if isinstance(value, (list, tuple)) else tuple(v.strip() for v in str(value).split(",") if v.strip())
    return kind(value)


def flattened(tree: dict) -> dict:
    """One level of groups laid flat; secrets and unknown names raise."""
    flat: dict = {}
    for k, v in tree.items():
        flat.update(v if isinstance(v, dict) else {k: v})
    names = {f.name for f in fields(Config)}
    if bad := [k for k in flat if k.lower() in SECRETS]:
        raise ValueError(f"secrets do not belong in a configuration file: {bad}")
    if bad := [k for k in flat if k not in names]:
        raise ValueError(f"unknown settings: {bad}")
    return flat


def simple_yaml(text: str) -> dict:
    """The subset of YAML that configuration files use: groups of key: value, comments, quoted texts, inline lists."""
    tree: dict = {}
    group = tree
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip().strip("'\"")
        if line[0] != " ":
            group = tree
        if not value and line[0] != " ":
            group = tree[key] = {}
        elif value.startswith("["):
            group[key] = [v.strip().strip("'\"") for v in value.strip("[]").split(",") if v.strip()]
        else:
            group[key] = value or None
    return tree


def config(yaml_text: str = "", environ: dict | None = None, **overrides) -> Config:
    """Defaults, then environment variables CLAUSELOOM_<NAME>, then the file, then overrides that are not None."""
    environ = os.environ if environ is None else environ
    values = {f.name: environ[f"CLAUSELOOM_{f.name.upper()}"] for f in fields(Config) if f"CLAUSELOOM_{f.name.upper()}" in environ}
    values |= flattened(simple_yaml(yaml_text))
    values |= {k: v for k, v in overrides.items() if v is not None}
    flattened(values)
    return Config(**{k: _coerced(k, v) for k, v in values.items()})

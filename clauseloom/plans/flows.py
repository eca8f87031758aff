"""Whole flows: ingest, ask and coded lookup as chains of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.embed import Embedder
from ..operators import grids, layout, markdown, provisions, search, validate
from ..operators.chunking import ChunkOptions, chunks


def to_markdown(words: DataFrame, boxes: DataFrame | None = None, ratio: float = 1.12, force: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, markdown from page words and table cell boxes: furniture dropped, headings and paragraphs found, tables
    stitched over page breaks, in reading order, with page anchors."""
    prose, tables = words, None
    if boxes is not None:
        found = grids.page_grids(words, boxes)
        span = boxes.select("doc_id", "page", F.explode("cells").alias("c")).groupBy("doc_id", "page").agg(F.min("c.x0").alias("x0"), F.min("c.top").alias("top"), F.max("c.x1").alias("x1"), F.max("c.bottom").alias("bottom"))
        prose = layout.words_outside(words, span)
    lines = layout.without_furniture(layout.lines(prose))
    if boxes is not None:
        tables = grids.rendered(grids.stitched(found, lines.select("doc_id", "page", "top")))
    x = layout.paragraphs(layout.headings(lines, ratio, force))
    heads = layout.merged_headings(x).select("doc_id", "page", "line_no", F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), "text").alias("block"))
    at = x.groupBy("doc_id", "page", "line_no").agg(F.first("top").alias("top"))
    heads = heads.join(at, ["doc_id", "page", "line_no"]).select("doc_id", "page", "top", "block")
    said = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    paras = x.where("heading_level is null").groupBy("doc_id", "para").agg(F.min("page").alias("page"), F.min_by("top", F.struct("page", "line_no")).alias("top"), said.alias("s")).select("doc_id", "page", "top", layout.rendered_paragraph(F.transform("s", lambda v: v["text"])).alias("block"))
    parts = heads.unionByName(paras)
    if tables is not None:
        wrapped = F.concat(F.lit("<!-- table id="), "table_id", F.lit(" pages="), F.col("page").cast("string"), F.lit(" -->\n"), "markdown", F.lit(f"\n{K.TABLE_CLOSE}"))
        parts = parts.unionByName(tables.select("doc_id", "page", "top", wrapped.alias("block")))
    pages = parts.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "block"))), lambda v: v["block"]), "\n\n").alias("body"))
    whole = F.array_sort(F.collect_list(F.struct("page", "body")))
    return pages.groupBy("doc_id").agg(whole.alias("ps")).select("doc_id", F.array_join(F.transform("ps", lambda p: F.concat(F.lit("<!-- page: "), p["page"].cast("string"), F.lit(" -->\n\n"), p["body"])), "\n\n").alias("markdown"))


def ingest(docs: DataFrame, options: ChunkOptions = ChunkOptions(), allow_review: bool = True) -> tuple[DataFrame, DataFrame]:
    """The reports of all documents (doc_id, markdown) and the chunks of those that the verdict lets on."""
    reports = validate.validate(docs)
    good = reports.where(F.col("verdict").isin("pass", "review") if allow_review else F.col("verdict") == "pass")
    return reports, chunks(markdown.blocks(docs.join(good.select("doc_id"), "doc_id", "left_semi")), options)


EMPTY = "I could not find anything in the indexed documents that answers this question."


def retrieve(chunk_table: DataFrame, vectors: DataFrame, questions: list[str], model: Embedder, k: int = 8, window: int = 1) -> DataFrame:
    """Sources for each question: hybrid hits and their neighbours, in order, up to the context budget."""
    spark: SparkSession = chunk_table.sparkSession
    asked = spark.createDataFrame([(i, q, model.embed_query(q)) for i, q in enumerate(questions)], "query_id int, question string, query array<double>")
    dense = search.vector_topk(vectors.select(F.col("chunk_id").alias("vec_id"), "embedding"), asked.select(F.col("query_id").cast("string").alias("query_id"), "query"), 2 * k).select(F.col("query_id").cast("int").alias("query_id"), F.col("vec_id").alias("id"), "rank")
    sparse = search.bm25(chunk_table.select(F.col("chunk_id").alias("doc_id"), F.concat_ws(" ", "embed_text", "breadcrumb").alias("text")), asked.select("query_id", T.search_tokens("question").alias("terms")), 2 * k).select("query_id", F.col("doc_id").alias("id"), "rank")
    hits = search.hybrid(dense, sparse, k).join(chunk_table.select(F.col("chunk_id").alias("id"), "doc_id", "seq", "type"), "id")
    near = search.with_neighbors(hits.select("query_id", "rank", "doc_id", "seq", "type", "score"), chunk_table, window)
    found = near.join(chunk_table, ["doc_id", "seq"])
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "neighbor", "doc_id", "seq"))
    label = F.concat_ws(", ", F.when(F.col("breadcrumb") != "", F.col("breadcrumb")).otherwise("Untitled section"), T.citation("page_start", "page_end", "printed_start", "printed_end", "form_code"))
    return search.context_budget(found.withColumn("place", place).withColumn("label", label))


def ask(sources: DataFrame, questions: list[str], answer: Callable[[str, str], str]) -> list[str]:
    """Answers by a pluggable model of (question, context); without sources the fixed refusal. Only the context of each
    question, of bounded size, reaches the driver."""
    held = {r["query_id"]: r["context"] for r in search.context_text(sources).collect()}
    return [answer(q, held[i]) if held.get(i) else EMPTY for i, q in enumerate(questions)]


def lookup(cases: DataFrame, docs: DataFrame, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """Ranked provisions and verdicts for cases (case_id, descriptors, synonyms) over documents (doc_id, markdown)."""
    units = provisions.units(markdown.blocks(docs)).withColumn("unit_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.format_string("%08d", "block"), F.format_string("%05d", "unit")))
    idf = provisions.idf_table(units)
    asked = provisions.query_terms(cases.withColumn("core", provisions.core_terms(F.concat("descriptors", "synonyms"))))
    found = provisions.search(asked, units, idf, top)
    about = units.select("unit_id", "text", "lead_in", T.citation("page_start", "page_end", "printed_start", "printed_end", "form_code").alias("citation"))
    ranked = found.join(about, "unit_id").join(cases.select("case_id", F.array_join("descriptors", " ").alias("said")), "case_id").withColumn("conflicts", T.conflicts("text", "said"))
    return ranked, provisions.assess(cases.select("case_id").join(ranked.where("rank = 1"), "case_id", "left"))

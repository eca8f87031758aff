"""Audit of split tables: their parts put together again and held against the extracted grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markdown import pipe_rows


def audit(chunks: DataFrame) -> DataFrame:
    """One row for each table of chunks (doc_id, table_id, part_index, part_total, text, breadcrumb): found and expected
    parts, missing and repeated part numbers, header variants, data rows, distinct and repeated rows, problems."""
    c = chunks.where("table_id is not null").withColumn("part_index", F.coalesce("part_index", F.lit(1)))
    per = c.groupBy("doc_id", "table_id").agg(
        F.count(F.lit(1)).alias("found"), F.min_by(F.coalesce("part_total", F.lit(1)), "part_index").alias("expected"), F.array_sort(F.collect_list("part_index")).alias("parts"), F.array_size(F.collect_set("breadcrumb")).alias("breadcrumbs"),
    )
    per = per.withColumn("missing", F.array_except(F.sequence(F.lit(1), F.greatest("expected", F.lit(1))), "parts"))
    per = per.withColumn("repeated", F.array_distinct(F.filter("parts", lambda p: F.size(F.filter("parts", lambda q: q == p)) > 1)))
    key = F.lower(F.array_join("cells", "|"))
    rows = pipe_rows(c.select("doc_id", "table_id", "part_index", "text")).withColumn("key", key)
    heads = rows.where("role = 'header'").groupBy("doc_id", "table_id").agg(F.countDistinct("key").alias("variants"), F.count(F.lit(1)).alias("headed"), F.min_by(F.size("cells"), "part_index").alias("width"))
    data = rows.where("role = 'data' and replace(key, '|', '') <> ''").groupBy("doc_id", "table_id", "key").agg(F.count(F.lit(1)).alias("n"))
    sums = data.groupBy("doc_id", "table_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.col("n") - 1).alias("repeated_rows"))
    x = per.join(heads, ["doc_id", "table_id"], "left").join(sums, ["doc_id", "table_id"], "left").na.fill(0, ["variants", "headed", "width", "rows", "distinct_rows", "repeated_rows"])
    problems = F.array(F.when(F.size("missing") > 0, "missing parts"), F.when(F.size("repeated") > 0, "duplicate parts"), F.when(F.col("variants") > 1, "header differs between parts").when((F.col("headed") > 0) & (F.col("headed") < F.col("found")), "parts without a header"))
    return x.withColumn("problems", F.filter(problems, lambda p: p.isNotNull())).withColumn("ok", F.size("problems") == 0)


def compared(audits: DataFrame, structures: DataFrame) -> DataFrame:
    """Audits with row_mismatch and column_mismatch against stored grids (doc_id, table_id, n_rows, header_rows,
    caption_rows, column_labels); both are null where no grid is on file."""
    s = structures.select("doc_id", "table_id", F.greatest(F.col("n_rows") - F.coalesce("header_rows", F.lit(1)) - F.coalesce("caption_rows", F.lit(0)), F.lit(0)).alias("expected_rows"), F.size("column_labels").alias("labels"))
    x = audits.join(s, ["doc_id", "table_id"], "left")
    return x.withColumns({"row_mismatch": (F.col("expected_rows") > 0) & (F.col("rows") != F.col("expected_rows")), "column_mismatch": (F.col("labels") > 0) & (F.col("width") > 0) & (F.col("width") != F.col("labels"))})


def reconciled(markdown_ids: DataFrame, structures: DataFrame) -> DataFrame:
    """doc_id, only_markdown, only_structure: table ids (doc_id, table_id) on one side only; structures are to be used
    only for documents without either."""
    m = markdown_ids.select("doc_id", "table_id", F.lit(1).alias("m"))
    s = structures.select("doc_id", "table_id", F.lit(1).alias("s"))
    x = m.join(s, ["doc_id", "table_id"], "full")
    return x.groupBy("doc_id").agg(F.count_if(F.col("s").isNull()).alias("only_markdown"), F.count_if(F.col("m").isNull()).alias("only_structure"))

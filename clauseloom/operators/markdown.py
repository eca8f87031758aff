"""Anchored Markdown: lines, the running state of page, form and headings, and blocks.

Documents are dealt by doc_id; every operator is a set of windows over (doc_id, pos), so a document's lines are read
in order without a Python loop. A document is a unit of reading order and is never split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

LEVELS = range(1, 7)


def lines(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """doc_id, pos, line: one row for each line, in order."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def classified(md: DataFrame) -> DataFrame:
    """Lines with kind, level, title, anchor values, and whether they are inside a table.

    kind is one of document, skipped, page, form, open, close, rows_open, rows_close, table, heading, blank, text. Both
    spellings of the skip anchor count; no line inside a table is a heading or text."""
    line = F.col("line")
    own = (
        F.when(line.rlike(K.SKIPPED_ANCHOR), "skipped").when(line.rlike(K.DOCUMENT_ANCHOR), "document").when(line.rlike(K.PAGE_ANCHOR), "page")
        .when(line.rlike(K.FORM_ANCHOR), "form").when(F.trim(line) == K.TABLE_CLOSE, "close").when(F.trim(line) == K.ROWS_OPEN, "rows_open")
        .when(F.trim(line) == K.ROWS_CLOSE, "rows_close").when(line.rlike(K.TABLE_OPEN), "open").when(line.rlike(K.HEADING), "heading")
        .when(F.trim(line) == "", "blank").otherwise("text")
    )
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = md.withColumn("own", own)
    opened = F.sum(F.when(F.col("own") == "open", 1).otherwise(0)).over(w)
    closed = F.sum(F.when(F.col("own") == "close", 1).otherwise(0)).over(w)
    out = out.withColumns({"table_no": opened, "inside": opened > closed})
    out = out.withColumn("kind", F.when(F.col("inside") & ~F.col("own").isin("open", "rows_open", "rows_close"), "table").otherwise(F.col("own")))
    heading = F.col("kind") == "heading"
    return out.withColumns({
        "level": F.when(heading, F.length(F.regexp_extract("line", K.HEADING, 1))),
        "title": F.when(heading, F.regexp_extract("line", K.HEADING, 2)),
        "attrs": F.when(F.col("kind") == "open", T.attributes(F.regexp_extract("line", K.TABLE_OPEN, 1))),
    }).drop("own")


def heading_paths(md: DataFrame) -> DataFrame:
    """Classified lines with section_path: the last heading of each level that no later heading of a lower or equal
    level has closed."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"h{n}": F.last(F.when(F.col("level") == n, F.struct("pos", "title")), ignorenulls=True).over(w) for n in LEVELS}
    out = md.withColumns(last)
    at = lambda n: F.coalesce(F.col(f"h{n}.pos"), F.lit(-1))
    parts = []
    for n in LEVELS:
        above = F.greatest(F.lit(-1), *(at(k) for k in range(1, n)), F.lit(-1))
        parts.append(F.when(at(n) > above, F.col(f"h{n}.title")))
    path = F.filter(F.array(*parts), lambda t: t.isNotNull())
    return out.withColumn("section_path", path).drop(*last)


def carried(md: DataFrame) -> DataFrame:
    """Classified lines with page, form_code and printed: the last anchors' values. Behind a table the page is the last
    one it names, if that is later, until the next anchor."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_page, is_form = F.col("kind") == "page", F.col("kind") == "form"
    named = F.coalesce(F.col("attrs")["pages"], F.lit(""))
    out = md.withColumns({
        "anchor": F.last(F.when(is_page, F.regexp_extract("line", K.PAGE_ANCHOR, 1).cast("int")), ignorenulls=True).over(w),
        "anchors": F.sum(F.when(is_page, 1).otherwise(0)).over(w),
        "form_code": F.last(F.when(is_form, F.regexp_extract("line", K.FORM_ANCHOR, 1)), ignorenulls=True).over(w),
        "printed": F.last(F.when(is_form, F.regexp_extract("line", K.FORM_ANCHOR, 2).cast("int")), ignorenulls=True).over(w),
        "table_page": F.coalesce(F.regexp_extract(named, r"^([0-9]+)-([0-9]+)$", 2).try_cast("int"), F.regexp_extract(named, r"^([0-9]+)-?$", 1).try_cast("int")),
    })
    since = Window.partitionBy("doc_id", "anchors").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    page = F.greatest(F.coalesce("anchor", F.lit(1)), F.coalesce(F.max("table_page").over(since), F.lit(0)))
    return out.withColumn("page", page).drop("anchor", "anchors", "table_page")


def blocks(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Paragraph and table blocks in reading order: doc_id, block (position of the first line), kind, text,
    row_sentences, section_path, page_start, page_end, form_code, printed_start, printed_end, meta.

    A heading, page anchor, blank line or table ends a paragraph; document, form and skip anchors do not."""
    md = carried(heading_paths(classified(lines(docs, text))))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.col("kind").isin("heading", "page", "blank", "open", "close")
    md = md.withColumn("para_no", F.sum(F.when(breaks, 1).otherwise(0)).over(w))
    said = F.struct("pos", "line")
    paras = (
        md.where("kind = 'text'").groupBy("doc_id", "para_no")
        .agg(F.min("pos").alias("block"), F.array_sort(F.collect_list(said)).alias("ls"), F.min_by("section_path", "pos").alias("section_path"), F.min_by("page", "pos").alias("page_start"), F.max_by("page", "pos").alias("page_end"), F.min_by("form_code", "pos").alias("form_code"), F.min_by("printed", "pos").alias("printed_start"), F.max_by("printed", "pos").alias("printed_end"))
        .select("doc_id", "block", F.lit("para").alias("kind"), F.regexp_replace(F.array_join(F.transform("ls", lambda x: F.regexp_replace(x["line"], r"\s+$", "")), "\n"), r"\s+$", "").alias("text"), F.lit("").alias("row_sentences"), "section_path", "page_start", "page_end", "form_code", "printed_start", "printed_end", F.lit(None).cast("map<string,string>").alias("meta"))
    )
    in_rows = F.sum(F.when(F.col("kind") == "rows_open", 1).when(F.col("kind") == "rows_close", -1).otherwise(0)).over(w)
    tab = md.withColumn("in_rows", in_rows).where("inside")
    opened = lambda c: F.min_by(c, "pos")
    keep = lambda flag: F.array_sort(F.collect_list(F.when((F.col("kind") == "table") & ((F.col("in_rows") > 0) == flag), said)))
    join = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    pages = F.regexp_extract_all(F.coalesce(F.col("meta")["pages"], F.lit("")), F.lit("[0-9]+"), F.lit(0))
    tables = (
        tab.groupBy("doc_id", "table_no").agg(F.min("pos").alias("block"), keep(False).alias("body"), keep(True).alias("details"), opened("section_path").alias("section_path"), opened("attrs").alias("meta"), opened("page").alias("page"), opened("form_code").alias("form_code"), opened("printed").alias("printed"))
        .select("doc_id", "block", F.lit("table").alias("kind"), F.trim(join("body")).alias("text"), F.trim(join("details")).alias("row_sentences"), "section_path", F.coalesce(F.try_element_at(pages, F.lit(1)).cast("int"), "page").alias("page_start"), F.coalesce(F.try_element_at(pages, F.lit(2)).cast("int"), F.try_element_at(pages, F.lit(1)).cast("int"), "page").alias("page_end"), "form_code", F.col("printed").alias("printed_start"), F.col("printed").alias("printed_end"), "meta")
    )
    return paras.unionByName(tables)


# ---- pipe tables


def pipe_cells(row):
    """The cells of a pipe row, trimmed; an escaped pipe stays inside its cell."""
    inner = F.regexp_replace(F.trim(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: T.squeeze(F.replace(F.replace(c, F.lit("<br>"), F.lit(" ")), F.lit("\\|"), F.lit("|"))))


def pipe_rows(tables: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line of each pipe table: the key columns of ``tables``, pos, cells, role (header, separator,
    data). A second row of only dashes, colons, blanks is the separator (also an all-blank one)."""
    keys = [c for c in tables.columns if c != text]
    got = tables.select(*keys, F.posexplode(F.filter(F.split(text, "\n"), lambda s: F.trim(s).startswith("|"))).alias("pos", "line"))
    second = (F.col("pos") == 1) & F.regexp_replace("line", r"\|", "").rlike(r"^[\s:-]*$")
    return got.select(*keys, "pos", "line", pipe_cells(F.col("line")).alias("cells"), F.when(F.col("pos") == 0, "header").when(second, "separator").otherwise("data").alias("role"))


def row_sentences(tables: DataFrame, text: str = "text") -> DataFrame:
    """Each data row as 'Group - Label: value | ...': the key columns, pos, banner, sentence. A row with text in its first
    cell only is a banner; it is carried on to the rows below and has no sentence of its own."""
    keys = [c for c in tables.columns if c != text]
    rows = pipe_rows(tables, text)
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first, rest = F.element_at("cells", 1), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    is_banner = (F.col("role") == "data") & (first != "") & ~F.exists(rest, lambda v: v != "")
    rows = rows.withColumn("is_banner", is_banner).withColumns({
        "labels": F.first(F.when(F.col("role") == "header", F.col("cells")), ignorenulls=True).over(w),
        "banner": F.last(F.when(is_banner, first), ignorenulls=True).over(w),
    })
    pairs = F.filter(F.transform(F.slice(F.arrays_zip("labels", "cells"), 1, F.least(F.size("labels"), F.size("cells"))), lambda p: F.when(p["cells"] != "", F.concat(p["labels"], F.lit(": "), p["cells"]))), lambda x: x.isNotNull())
    body = F.array_join(pairs, " | ")
    out = rows.where((F.col("role") == "data") & ~F.col("is_banner")).withColumn("body", body).where("body <> ''")
    return out.select(*keys, "pos", F.coalesce("banner", F.lit("")).alias("banner"), F.concat(F.when(F.coalesce("banner", F.lit("")) != "", F.concat("banner", F.lit(" - "))).otherwise(""), F.col("body")).alias("sentence"))


def empty_ratio(tables: DataFrame, text: str = "text", most: float = 0.35) -> DataFrame:
    """cells, empty and needs_review (over ``most`` of the data cells are empty) for each pipe table."""
    keys = [c for c in tables.columns if c != text]
    rows = pipe_rows(tables, text).where("role = 'data'")
    got = rows.groupBy(*keys).agg(F.sum(F.size("cells")).alias("cells"), F.sum(F.size(F.filter("cells", lambda v: v == ""))).alias("empty"))
    return got.withColumn("needs_review", F.col("empty") / F.col("cells") > most)


def html_cells(row):
    """The texts of an HTML table row's cells."""
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: T.squeeze(F.regexp_replace(c, "<[^>]+>", " ")))


def html_rows(tables: DataFrame, text: str = "text") -> DataFrame:
    """pos, role and cells of each row of HTML tables; a caption before the table does not hide it."""
    keys = [c for c in tables.columns if c != text]
    got = tables.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)<tr>.*?</tr>"), F.lit(0))).alias("pos", "row"))
    return got.select(*keys, "pos", F.when(F.col("row").contains("<th"), "header").otherwise("data").alias("role"), html_cells(F.col("row")).alias("cells"))


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id, pos, level, title of the headings of HTML pages."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "h"))
    return rows.select("page_id", "pos", F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), T.squeeze(F.regexp_replace("h", "<[^>]+>", " ")).alias("title"))

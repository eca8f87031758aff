"""Page layout: lines from words, running lines, sizes, headings, numbering, forms, languages, contents pages.

Words: doc_id, page, word_idx, text, x0, x1, top, bottom, size, fontname, page_height. Lines: doc_id, page, line_no,
text, x0, x1, top, bottom, size, bold, size_frac, page_height.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

LINE = "page int, line_no int, text string, x0 double, x1 double, top double, bottom double, size double, bold boolean, size_frac double, page_height double"


def _line_of(group: pd.DataFrame) -> tuple:
    g = group.sort_values("x0", kind="stable")
    weight = g["text"].str.len()
    sizes = weight.groupby(g["size"].round(1), sort=False).sum()
    sized = weight[g["size"].notna()]
    size = float(sizes.idxmax()) if len(sizes) else 0.0
    bold = g["fontname"].fillna("").str.contains("bold|black|heavy|semib|demi", case=False)
    total = float(sized.sum())
    share = float(sizes.max()) / total if total else 0.0
    return (" ".join(g["text"]), float(g["x0"].min()), float(g["x1"].max()), float(g["top"].min()), float(g["bottom"].max()), size, bool(total and weight[bold & g["size"].notna()].sum() / total > 0.6), share)


def lines(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Lines of each page: words in order of top, a new line where a word's top is over ``tolerance`` from the top of the
    line's first word; size is the one with most characters, bold holds over 0.6 of the sized characters."""
    kind = words.schema["doc_id"].dataType.simpleString()

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "x0", "word_idx"], kind="stable").reset_index(drop=True)
        no, first, at = -1, None, []
        for top in page["top"]:
            if first is None or abs(top - first) > tolerance:
                no, first = no + 1, top
            at.append(no)
        rows = [(page["doc_id"][0], int(page["page"][0]), i, *_line_of(g), float(page["page_height"][0])) for i, g in page.groupby(pd.Series(at))]
        return pd.DataFrame(rows, columns=["doc_id", *(c.split()[0] for c in LINE.split(", "))])

    return words.groupBy("doc_id", "page").applyInPandas(fold, f"doc_id {kind}, {LINE}")


def in_band(band: float, top="top", bottom="bottom", height="page_height"):
    return (F.col(top) <= F.col(height) * band) | (F.col(bottom) >= F.col(height) * (1 - band))


def running_lines(lines: DataFrame, band: float = 0.10, share: float = 0.45, most: int = 10) -> DataFrame:
    """doc_id, key, pages of the lines that run in the bands of many pages: at least 3, and the lower of ``most`` and a
    share of the pages. Line breaks of digits count as equal."""
    n = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    keyed = lines.where(in_band(band)).select("doc_id", "page", T.running_key("text").alias("key")).where("key <> ''")
    pages = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages"))
    least = F.greatest(F.lit(3), F.least(F.floor(F.col("n") * share), F.lit(most)))
    return pages.join(n, "doc_id").where(F.col("pages") >= least).select("doc_id", "key", "pages")


def without_furniture(lines: DataFrame, band: float = 0.10) -> DataFrame:
    """Lines but those in a band that run over pages or are page numbers."""
    keyed = lines.withColumns({"key": T.running_key("text"), "banded": in_band(band)})
    running = running_lines(lines, band).select("doc_id", "key", F.lit(True).alias("runs"))
    flagged = keyed.join(running, ["doc_id", "key"], "left")
    return flagged.where(~(F.col("banded") & (F.coalesce("runs", F.lit(False)) | T.is_page_number("text")))).drop("key", "banded", "runs")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body_size: the size with most characters, the first seen among equals; 10 without any."""
    per = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page", "line_no")).alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first")
    return per.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", F.coalesce("size", F.lit(10.0)).alias("body_size"))


def size_levels(lines: DataFrame, ratio: float = 1.12, most: int = 6) -> DataFrame:
    """doc_id, size, level: the distinct sizes from ratio times the body's on, largest first, of lines of up to 160
    characters."""
    sized = lines.where(F.length("text") <= 160).join(body_size(lines), "doc_id").where(F.col("size") >= F.col("body_size") * ratio)
    distinct = sized.select("doc_id", "size").distinct()
    level = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return distinct.withColumn("level", level).where(F.col("level") <= most)


def headings(lines: DataFrame, ratio: float = 1.12, force: tuple[str, ...] = (), bold_counts: bool = False, caps_count: bool = False) -> DataFrame:
    """Lines with heading_level (1 to 6) or null. The rules are tried in order; the first that fits decides."""
    levels = size_levels(lines, ratio)
    deepest_known = levels.groupBy("doc_id").agg(F.max("level").alias("deepest_known"))
    x = lines.join(body_size(lines), "doc_id").join(levels, ["doc_id", "size"], "left").join(deepest_known, "doc_id", "left")
    t = F.trim("text")
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    key = t.rlike(K.KEYWORD)
    key_hits = F.regexp_count(t, F.lit(K.KEYWORD))
    goes_on = t.rlike(K.CONTINUATION)
    large, bold, level = F.col("size") > F.col("body_size"), F.col("bold"), F.col("level")
    sentence = t.rlike(K.SENTENCE_END) & (n > 70)
    deepest = F.least(F.coalesce("deepest_known", F.lit(1)) + 1, F.lit(5))
    none = F.lit(None).cast("int")
    rule = F.when((n == 0) | (n > 160), none).when(t.rlike(K.BULLET) & ~key & ~(level.isNotNull() | (bold & large)), none)
    for p in force:
        rule = rule.when(t.rlike(f"(?i){p}"), 1)
    rule = (
        rule.when(letters < 3, none)
        .when(key & large & (n <= 70) & ~goes_on & (key_hits <= 1), 1)
        .when(F.col("size_frac") < 0.75, none)
        .when(key & (goes_on | (n > 70) | (key_hits > 1)), none)
        .when(level.isNotNull() & ~sentence, level)
        .when(key & (n < 120), F.when((large | bold) & ~t.endswith("."), F.least(deepest, F.lit(2))))
        .when(F.lit(caps_count) & (upper / letters > 0.9) & (n < 110) & ~sentence, deepest)
        .when(F.lit(bold_counts) & bold & (n < 110) & ~sentence, deepest)
        .when(t.rlike(K.NUMBERED) & (bold | large) & (n < 110), F.least(deepest + 1, F.lit(6)))
    )
    return x.withColumn("heading_level", rule).drop("level", "deepest_known", "body_size")


def left_margin(lines: DataFrame) -> DataFrame:
    """doc_id, margin: the leftmost rounded x0 that holds at least 5 % of the characters of the fullest one."""
    per = lines.groupBy("doc_id", F.bround("x0").alias("x")).agg(F.sum(F.length("text")).alias("chars"))
    most = F.max("chars").over(Window.partitionBy("doc_id"))
    return per.withColumn("most", most).where(F.col("chars") >= 0.05 * F.col("most")).groupBy("doc_id").agg(F.min("x").alias("margin"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with para: a new one on a new page, after a gap over 0.9 of the median height, at a bullet, or at an indent
    of over 18 with a gap over 0.35 of it."""
    by_page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    height = F.col("bottom") - F.col("top")
    med = lines.groupBy("doc_id", "page").agg(F.percentile(height, 0.5).alias("height"))
    x = lines.join(med, ["doc_id", "page"]).withColumns({"gap": F.col("top") - F.lag("bottom").over(by_page), "indent": F.col("x0") - F.lag("x0").over(by_page)})
    new = F.col("gap").isNull() | (F.col("gap") > 0.9 * F.col("height")) | F.col("text").rlike(K.BULLET) | ((F.col("indent") > 18) & (F.col("gap") > 0.35 * F.col("height")))
    w = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("para", F.sum(F.when(new, 1).otherwise(0)).over(w)).drop("gap", "indent", "height")


def merged_headings(lines: DataFrame) -> DataFrame:
    """Wrapped headings as one: doc_id, page, line_no (first), heading_level, text. Consecutive lines of a page with the
    same level, sizes within 0.6 and a gap of up to 0.8 of the height go together."""
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    gap = F.col("top") - F.lag("bottom").over(w)
    joins = (F.lag("heading_level").over(w) == F.col("heading_level")) & (F.lag("page").over(w) == F.col("page")) & (F.abs(F.col("size") - F.lag("size").over(w)) < 0.6) & (gap >= 0) & (gap <= 0.8 * (F.col("bottom") - F.col("top")))
    x = lines.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    return x.where("heading_level is not null").groupBy("doc_id", "run", "heading_level").agg(F.min(F.struct("page", "line_no")).alias("at"), said.alias("s")).select("doc_id", "at.page", "at.line_no", "heading_level", F.array_join(F.transform("s", lambda v: v["text"]), " ").alias("text"))


def rendered_paragraph(texts):
    """An array of a paragraph's lines as one text: a hyphen at a line's end before a small letter goes."""
    step = lambda a, s: F.when(a == "", s).when(a.rlike(r"[A-Za-z]-$") & s.rlike("^[a-z]"), F.concat(F.regexp_replace(a, "-$", ""), s)).otherwise(F.concat(a, F.lit(" "), s))
    return F.aggregate(texts, F.lit(""), step)


def inline_bullets(text):
    """The parts of a run-on paragraph at its bullets."""
    return F.filter(F.transform(F.split(text, K.INLINE_BULLET), F.trim), lambda p: p != "")


def indent_level(x0, margin, step: float = 12.0):
    return F.greatest(F.lit(0), F.least(F.lit(3), F.bround((x0 - margin) / step).cast("int")))


# ---- numbering and forms


def page_numbering(words: DataFrame, band: float = 0.12) -> DataFrame:
    """doc_id, offset, first_page, confidence, consistent, examined. Every number in a band votes for the offset between
    the page's place and itself (0 to 60); the document's offset is the one with most votes, the smallest among equals;
    numbering begins on the first consistent page with three in five."""
    pages = words.groupBy("doc_id").agg(F.countDistinct("page").alias("examined"))
    token = F.regexp_replace(F.trim("text"), r"^[.)(-]+|[.)(-]+$", "")
    votes = words.where(in_band(band)).select("doc_id", "page", token.alias("t")).where(F.col("t").rlike("^[0-9]{1,4}$")).select("doc_id", "page", (F.col("page") - F.col("t").cast("int")).alias("offset"), F.col("t").cast("int").alias("v")).where("v >= 1").distinct()
    per = votes.where("offset between 0 and 60").groupBy("doc_id", "offset").agg(F.count(F.lit(1)).alias("agree"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("agree"), "offset")
    best = per.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "offset", "agree")
    same = votes.join(best, ["doc_id", "offset"]).select("doc_id", "offset", "agree", "page").distinct()
    five = Window.partitionBy("doc_id").orderBy("page").rangeBetween(0, 4)
    same = same.withColumn("five", F.count(F.lit(1)).over(five))
    got = same.groupBy("doc_id", "offset", "agree").agg(F.count(F.lit(1)).alias("consistent"), F.min("page").alias("any_first"), F.min(F.when(F.col("five") >= 3, F.col("page"))).alias("run_first"))
    first = F.when(F.col("consistent") > 2, F.coalesce("run_first", "any_first")).otherwise(F.col("any_first"))
    return pages.join(got, "doc_id", "left").select("doc_id", "offset", first.alias("first_page"), F.round(F.coalesce("agree", F.lit(0)) / F.col("examined"), 3).alias("confidence"), F.coalesce("consistent", F.lit(0)).alias("consistent"), "examined")


def roman_pages(words: DataFrame, band: float = 0.12, most: int = 50) -> DataFrame:
    """doc_id, page, value of pages whose bands hold a roman numeral of up to ``most``."""
    token = F.regexp_replace(F.trim("text"), r"^[.)(-]+|[.)(-]+$", "")
    got = words.where(in_band(band)).select("doc_id", "page", token.alias("t")).where(F.col("t").rlike("(?i)^[ivxlcdm]{1,7}$")).withColumn("value", T.roman_to_int("t"))
    return got.where(F.col("value") <= most).groupBy("doc_id", "page").agg(F.min("value").alias("value"))


def form_sections(words: DataFrame, band: float = 0.12) -> DataFrame:
    """Runs of contiguous pages with the same form code in their footers: doc_id, run, form_code, pages and printed
    pages, and found (at least two runs over at least 0.3 of the pages)."""
    foot = words.where(F.col("bottom") >= F.col("page_height") * (1 - band)).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ").alias("footer"))
    coded = foot.withColumn("f", T.form_code("footer")).where("f is not null").select("doc_id", "page", F.col("f.code").alias("form_code"), F.col("f.number").alias("printed"))
    w = Window.partitionBy("doc_id").orderBy("page")
    goes_on = (F.lag("form_code").over(w) == F.col("form_code")) & (F.lag("page").over(w) == F.col("page") - 1)
    runs = coded.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "run", "form_code").agg(F.min("page").alias("pdf_start"), F.max("page").alias("pdf_end"), F.min_by("printed", "page").alias("printed_start"), F.max_by("printed", "page").alias("printed_end"))
    whole = words.groupBy("doc_id").agg(F.countDistinct("page").alias("examined")).join(coded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("coded")), "doc_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return out.join(whole, "doc_id").withColumn("found", (n >= 2) & (F.col("coded") / F.col("examined") >= 0.30)).drop("coded", "examined")


def printed_pages(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """Pages (doc_id, page) with the form they lie in and the printed page: printed_start + page - pdf_start."""
    hit = (pages["doc_id"] == forms["doc_id"]) & F.col("page").between(F.col("pdf_start"), F.col("pdf_end"))
    return pages.join(forms, hit, "left").select(pages["doc_id"], "page", "form_code", (F.col("printed_start") + F.col("page") - F.col("pdf_start")).alias("printed"))


def page_language(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with words, non_latin, english and foreign. Short pages are never foreign; else a page is if many of its
    letters are outside Latin, or few of its words are English function words."""
    t = F.coalesce(text, F.lit(""))
    ws = F.regexp_extract_all(F.lower(t), F.lit(r"[A-Za-z\x{c0}-\x{24f}]+"), F.lit(0))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    far = F.length(F.regexp_replace(t, r"[^\p{L}]|[\x{0}-\x{2c0}]", ""))
    english = F.size(F.filter(ws, lambda w: w.isin(*K.ENGLISH_WORDS)))
    out = pages.withColumns({"words": F.size(ws), "letters": letters, "far": far, "hits": english})
    judged = (F.col("words") >= K.MIN_PAGE_WORDS) & (F.col("letters") > 0)
    share, known = F.col("far") / F.col("letters"), F.col("hits") / F.col("words")
    foreign = judged & ((share >= K.NON_LATIN_SHARE) | (known < K.ENGLISH_SHARE))
    return out.withColumns({"non_latin": F.when(judged, F.round(share, 3)).otherwise(0.0), "english": F.when(judged, F.round(known, 3)).otherwise(1.0), "foreign": foreign}).drop("letters", "far", "hits")


def without_foreign(pages: DataFrame, text: str = "text") -> DataFrame:
    return page_language(pages, text).where("not foreign").select(*pages.columns)


def dot_leader_pages(lines: DataFrame, least: float = 0.4) -> DataFrame:
    """doc_id, page of pages of at least five lines of over three characters, of which ``least`` have dot leaders."""
    body = lines.where(F.length(F.trim("text")) > 3).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike(K.TOC_DOT_LINE)).alias("k"))
    return body.where((F.col("n") >= 5) & (F.col("k") / F.col("n") >= least)).select("doc_id", "page")


def contents_pages(pages: DataFrame, limit: int = 30, least: int = 5) -> DataFrame:
    """The first contiguous run of contents pages among the first ``limit``: doc_id, page, entries, titled. A page
    qualifies if it has entries and a title, or if entries are half of its lines and at least ``least``."""
    ls = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != "")
    got = pages.where(F.col("page") <= limit).select("doc_id", "page", F.size(ls).alias("n"), F.filter(F.transform(ls, T.toc_entry), lambda e: e.isNotNull()).alias("entries"), F.exists(ls, lambda s: s.rlike(K.TOC_TITLE)).alias("titled"))
    k = F.size("entries")
    hits = got.where((k > 0) & (F.col("titled") | ((k / F.col("n") >= 0.5) & (k >= least))))
    w = Window.partitionBy("doc_id").orderBy("page")
    run = F.col("page") - F.row_number().over(w)
    first = hits.withColumn("run", run).withColumn("first", F.min("run").over(Window.partitionBy("doc_id")))
    return first.where("run = first").select("doc_id", "page", "entries", "titled")


def words_outside(words: DataFrame, boxes: DataFrame, pad: float = 1.0) -> DataFrame:
    """Words whose centre lies in no box (doc_id, page, x0, top, x1, bottom) of their page."""
    cx, cy = (words["x0"] + words["x1"]) / 2, (words["top"] + words["bottom"]) / 2
    inside = (words["doc_id"] == boxes["doc_id"]) & (words["page"] == boxes["page"]) & cx.between(boxes["x0"] - pad, boxes["x1"] + pad) & cy.between(boxes["top"] - pad, boxes["bottom"] + pad)
    return words.join(boxes, inside, "left_anti")

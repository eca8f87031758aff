"""The registered queries over the analytics operators and the SQL that states their results.

The test tables hold no Markdown, forms or contents pages, so these are laid over their rows inside each query, by the
same rule in Spark and in SQL: ``markdown_of`` gives each document headings, page anchors and paragraphs; ``part_tables``
gives pipe tables of 40 parts; lines of a document stand for lines of pages of 12.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import embed
from ..functions import text as T
from ..operators import audit, chunking, grids, inventory, layout, markdown, provisions, search, store, validate
from ..sources import readers
from ..streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
TITLES = ("Section 1: Exclusions and Limitations", "Schedule of Benefits", "Section 9: Defined Terms", "Appendix A: Programs", "Notes")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs, in Spark and in SQL


def markdown_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, markdown."""
    none = F.array().cast("array<string>")

    def laid(s, i):
        page = F.when(i % 2 == 0, F.array(F.concat(F.lit("<!-- page: "), (F.floor(i / 2) + 1).cast("string"), F.lit(" -->")))).otherwise(none)
        n = F.pmod(F.col("doc_id") + i, F.lit(5)).cast("int") + 1
        head = F.concat(F.repeat(F.lit("#"), (F.pmod(F.col("doc_id") + i, F.lit(3)) + 1).cast("int")), F.lit(" "), F.element_at(F.array(*(F.lit(t) for t in TITLES)), n))
        return F.concat(page, F.when(i % 3 == 0, F.array(head)).otherwise(none), F.array(F.lit(""), s, F.lit("")))

    lines = F.transform(F.split("text", "\n"), laid)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.flatten(lines), "\n").alias("markdown"))


_TITLE_LIST = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
MD = f"""mdoc AS (SELECT doc_id, array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda s, i:
  list_concat(list_concat(CASE WHEN (i - 1) % 2 = 0 THEN ['<!-- page: ' || ((i - 1) // 2 + 1)::VARCHAR || ' -->'] ELSE []::VARCHAR[] END,
  CASE WHEN (i - 1) % 3 = 0 THEN [repeat('#', ((doc_id + i - 1) % 3 + 1)::INT) || ' ' || ({_TITLE_LIST})[((doc_id + i - 1) % 5 + 1)::INT]] ELSE []::VARCHAR[] END), ['', s, '']))), chr(10)) AS markdown FROM documents),
ml0 AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS pos FROM mdoc),
ml AS (SELECT *, CASE WHEN regexp_matches(line, '{K.PAGE_ANCHOR}') THEN 'page' WHEN regexp_matches(line, '{K.HEADING}') THEN 'heading' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM ml0),
mh AS (SELECT *, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '{K.HEADING}', 1)) END AS level, CASE WHEN kind = 'heading' THEN regexp_extract(line, '{K.HEADING}', 2) END AS title,
  CASE WHEN kind = 'page' THEN regexp_extract(line, '{K.PAGE_ANCHOR}', 1)::INT END AS anchor FROM ml),
mc AS (SELECT *, {", ".join(f"max(CASE WHEN level = {n} THEN pos END) OVER w AS p{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in range(1, 7))},
  coalesce(last_value(anchor IGNORE NULLS) OVER w, 1) AS page, sum(CASE WHEN kind IN ('heading', 'page', 'blank') THEN 1 ELSE 0 END) OVER w AS para_no
  FROM mh WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
mp AS (SELECT *, list_filter([{", ".join(f"CASE WHEN p{n} IS NOT NULL AND p{n} > greatest(-1, {', '.join([f'coalesce(p{k}, -1)' for k in range(1, n)] or ['-1'])}) THEN t{n} END" for n in range(1, 7))}], lambda x: x IS NOT NULL) AS path FROM mc),
mb AS (SELECT doc_id, min(pos) AS block, rtrim(string_agg(rtrim(line), chr(10) ORDER BY pos)) AS text, arg_min(path, pos) AS path, min(page) AS page_start, max(page) AS page_end FROM mp WHERE kind = 'text' GROUP BY doc_id, para_no),
mr AS (SELECT *, CASE WHEN len(path) = 0 THEN '(no heading)' ELSE array_to_string(path, ' > ') END AS breadcrumb FROM mb),
mo AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS occurrence FROM (SELECT *, CASE WHEN lag(breadcrumb) OVER (PARTITION BY doc_id ORDER BY block) = breadcrumb THEN 0 ELSE 1 END AS new FROM mr)),
sec AS (SELECT doc_id, occurrence, any_value(breadcrumb) AS breadcrumb, coalesce(any_value(path)[-1], '(no heading)') AS heading, len(any_value(path)) AS depth, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS text_blocks, 0 AS tables, sum(length(text)) AS chars FROM mo GROUP BY doc_id, occurrence)"""


def tables_markdown_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, markdown: a page anchor before every fourth line, and behind every third line a table that names the page it
    is on, or two or three pages, or none."""
    none = F.array().cast("array<string>")

    def laid(s, i):
        page = (F.floor(i / 4) + 1).cast("string")
        anchor = F.when(i % 4 == 0, F.array(F.concat(F.lit("<!-- page: "), page, F.lit(" -->")))).otherwise(none)
        last = (F.floor(i / 4) + 1 + F.pmod(F.col("doc_id") + i, F.lit(3))).cast("string")
        pages = F.when(i % 2 == 0, F.concat(F.lit(" pages="), page, F.lit("-"), last)).when(i % 5 == 0, F.concat(F.lit(" pages="), page)).otherwise("")
        opened = F.concat(F.lit("<!-- table id=t"), i.cast("string"), pages, F.lit(" -->"))
        grid = F.array(opened, F.lit("| Name | Days |"), F.lit("| --- | --- |"), F.concat(F.lit("| "), F.length(s).cast("string"), F.lit(" | 3 |")), F.lit("<!-- /table -->"))
        return F.concat(anchor, F.array(F.lit(""), F.concat(F.lit("line "), i.cast("string")), F.lit("")), F.when(i % 3 == 0, grid).otherwise(none))

    lines = F.transform(F.split("text", "\n"), laid)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.flatten(lines), "\n").alias("markdown"))


#: The same layout as rows: i is the line, a table follows where i % 3 = 0.
MT = """ti AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
tt AS (SELECT *, i // 4 + 1 AS anchor, CASE WHEN i % 3 <> 0 THEN NULL WHEN i % 2 = 0 THEN i // 4 + 1 + (doc_id + i) % 3 WHEN i % 5 = 0 THEN i // 4 + 1 END AS named FROM ti),
tc AS (SELECT *, greatest(anchor, coalesce(max(named) OVER (PARTITION BY doc_id, anchor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS page FROM tt)"""


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, table_id, text: pipe tables of 40 parts, with banner rows, blank cells and a ragged row here and there."""
    p = table(spark, sf_dir, "part").withColumn("t", F.floor(F.col("p_partkey") / 40))
    price = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.format_string("up to %d days", F.col("p_size")))
    row = F.when(F.col("p_partkey") % 7 == 3, F.concat(F.lit("| "), "p_type", F.lit(" |  |  |"))).when(F.col("p_partkey") % 97 == 5, F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |"))).otherwise(F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" | "), price, F.lit(" |")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"])
    got = p.groupBy("t").agg(rows.alias("rows"))
    return got.select(F.floor(F.col("t") / 5).alias("doc_id"), F.concat(F.lit("t"), F.col("t").cast("string")).alias("table_id"), F.array_join(F.concat(F.array(F.lit("| Name | Brand | Limit |"), F.lit("| --- | --- | --- |")), "rows"), "\n").alias("text"))


PT = """ptab AS (SELECT t // 5 AS doc_id, 't' || t AS table_id, t, '| Name | Brand | Limit |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(r, chr(10) ORDER BY p_partkey) AS text FROM (
  SELECT p_partkey, p_partkey // 40 AS t, CASE WHEN p_partkey % 7 = 3 THEN '| ' || p_type || ' |  |  |' WHEN p_partkey % 97 = 5 THEN '| ' || p_name || ' | ' || p_brand || ' |'
    ELSE '| ' || p_name || ' | ' || p_brand || ' | ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'up to ' || p_size || ' days' END || ' |' END AS r FROM part) GROUP BY t),
pl AS (SELECT doc_id, table_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM ptab),
pc AS (SELECT *, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g'))) AS cells, CASE pos WHEN 0 THEN 'header' WHEN 1 THEN 'separator' ELSE 'data' END AS role FROM pl)"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages: doc_id, page, line_no, text, x0, x1, top, bottom, size, bold, size_frac, page_height. Each page has a
    running head, 12 lines of the document, and its number at the foot."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumns({"page": (F.floor(F.col("i") / 12) + 1).cast("int"), "line_no": (F.col("i") % 12 + 1).cast("int")})
    own = d.select("doc_id", "page", "line_no", "text")
    pages = d.select("doc_id", "page").distinct()
    head = pages.select("doc_id", "page", F.lit(0).alias("line_no"), F.concat(F.lit("Plan 20"), F.format_string("%02d", F.col("page") % 100), F.lit("  Booklet")).alias("text"))
    foot = pages.select("doc_id", "page", F.lit(13).alias("line_no"), F.concat(F.lit("Page "), (F.col("page") + 2).cast("string")).alias("text"))
    x = own.unionByName(head).unionByName(foot)
    top = F.col("line_no") * 60.0 + 5.0
    return x.withColumns({"x0": 72.0 + F.pmod(F.length("text"), F.lit(3)) * 10.0, "x1": F.lit(500.0), "top": top, "bottom": top + 12.0, "size": F.when(F.length("text") % 11 == 0, 14.0).otherwise(10.0), "bold": F.length("text") % 7 == 0, "size_frac": F.lit(1.0), "page_height": F.lit(800.0)})


PL = """pd AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
pg AS (SELECT DISTINCT doc_id, i // 12 + 1 AS page FROM pd),
pa AS (SELECT doc_id, i // 12 + 1 AS page, i % 12 + 1 AS line_no, text FROM pd
  UNION ALL SELECT doc_id, page, 0, 'Plan 20' || printf('%02d', page % 100) || '  Booklet' FROM pg UNION ALL SELECT doc_id, page, 13, 'Page ' || (page + 2) FROM pg),
plines AS (SELECT *, 72.0 + (length(text) % 3) * 10.0 AS x0, line_no * 60.0 + 5.0 AS top, line_no * 60.0 + 17.0 AS bottom, CASE WHEN length(text) % 11 = 0 THEN 14.0 ELSE 10.0 END AS size, 800.0 AS h FROM pa)"""
STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)


def toks(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({STOP}))"


def sents(c: str) -> str:
    bare = "trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""flatten(list_transform(list_filter(list_transform(string_split({c}, chr(10)), lambda s: {bare}), lambda s: s <> ''), lambda s: CASE WHEN s[1] IN ('-', '*', '•') THEN [ltrim(s, '-*• ')]
  ELSE list_filter(list_transform(string_split(regexp_replace(s, '([.;:])\\s+([A-Z(])', concat('\\1', chr(30), '\\2'), 'g'), chr(30)), lambda s: {bare}), lambda p: length(p) > 15) END))"""


# ---- tokens, weights, sentences


@query(f"""WITH e AS (SELECT doc_id, unnest({toks('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf FROM e GROUP BY term""")
def term_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.search_tokens("text")).alias("term"))
    per = e.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@query(f"""WITH e AS (SELECT doc_id, unnest(list_distinct({toks('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*)::BIGINT AS df, round(ln(1 + any_value(n) / (1 + count(*))), 6) AS idf FROM e, n GROUP BY term""")
def idf_table(spark, sf_dir):
    return provisions.idf_table(table(spark, sf_dir, "documents")).withColumn("idf", F.round("idf", 6))


@query(f"""WITH s AS (SELECT doc_id, {sents('text')} AS l FROM documents)
SELECT doc_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS at FROM s""")
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("at", "sentence"))


@query("SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::INT AS n_tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens("text").alias("n_tokens"))


@query("""SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9$%]+'), lambda t: lower(t)) AS tokens FROM documents""")
def audit_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.audit_tokens("text").alias("tokens"))


def _sentence_units(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("at", "text"))
    return d.select(F.format_string("%010d:%05d", "doc_id", "at").alias("unit_id"), "doc_id", "text", F.lit("exclusion").alias("scope"))


@query(f"""WITH {MT} SELECT doc_id, 'para' AS kind, 'line ' || i AS text, page::INT AS page_start, page::INT AS page_end, NULL AS table_id FROM tc
UNION ALL SELECT doc_id, 'table', '| Name | Days |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || length(s) || ' | 3 |', (CASE WHEN named IS NULL THEN page ELSE anchor END)::INT, coalesce(named, page)::INT, 't' || i FROM tc WHERE i % 3 = 0""")
def md_table_pages(spark, sf_dir):
    b = markdown.blocks(tables_markdown_of(spark, sf_dir))
    return b.select("doc_id", "kind", "text", "page_start", "page_end", F.col("meta")["id"].alias("table_id"))


@query(f"""WITH {MD} SELECT DISTINCT value FROM (SELECT unnest(path) AS value FROM mb) WHERE regexp_matches(lower(value), '{K.SCOPES[0][1]}') OR regexp_matches(lower(value), '{K.SCOPES[1][1]}')""")
def scoped_section_values(spark, sf_dir):
    return inventory.section_values(markdown.blocks(markdown_of(spark, sf_dir)), ("exclusion", "limitation"))


@query(f"""WITH {MD}, dv AS (SELECT doc_id, block, unnest(path) AS name, generate_subscripts(path, 1) AS depth, page_start FROM mb)
SELECT doc_id, name, arg_min(depth, (block, depth))::INT AS depth, arg_min(page_start, (block, depth))::INT AS page FROM dv WHERE regexp_matches(name, '{K.NAMED_DIVISION}') GROUP BY doc_id, name""")
def named_divisions(spark, sf_dir):
    return inventory.divisions(markdown.blocks(markdown_of(spark, sf_dir)))


@query("SELECT vec_id AS chunk_id, label FROM embeddings")
def fixed_projection(spark, sf_dir):
    return store.projected(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "_id"))


def _item_cases(spark, sf_dir):
    """A case for each benchmark item: its distinct tokens."""
    core = F.array_distinct(T.search_tokens("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), core.alias("core"), core.alias("terms")).where(F.size("core") > 0)


SEARCH = f"""s AS (SELECT doc_id, {sents('text')} AS l FROM documents),
u AS (SELECT printf('%010d:%05d', doc_id, ord) AS unit_id, doc_id, text FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM s)),
ut AS (SELECT unit_id, list_distinct({toks('text')}) AS ts FROM u),
po AS (SELECT unit_id, len(ts) AS n_tokens, unnest(ts) AS term FROM ut),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM u) / (1 + count(*))) AS idf FROM po GROUP BY term),
c0 AS (SELECT item_id AS case_id, {toks('text')} AS l FROM benchmark),
c1 AS (SELECT case_id, list_transform(list_filter(l, lambda t, i: list_position(l, t) = i), lambda t: t) AS terms FROM c0),
c2 AS (SELECT case_id, len(terms) AS n_terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS ord FROM c1),
m AS (SELECT case_id, unit_id, n_terms, n_tokens, list(coalesce(idf, 1.0) ORDER BY ord) AS ws, string_agg(c2.term, ' ' ORDER BY ord) AS matched FROM c2 JOIN po USING (term) LEFT JOIN idf USING (term) GROUP BY case_id, unit_id, n_terms, n_tokens),
sc AS (SELECT *, round(list_reduce(ws, lambda a, b: a + b) * (0.5 + len(ws) / n_terms) * (1 / (1 + ln(1 + greatest(n_tokens - 12, 0)))), 4) AS score FROM m),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, unit_id) AS rank FROM sc WHERE score > 0)"""


@query(f"WITH {SEARCH} SELECT case_id, rank::INT AS rank, unit_id, score, matched FROM rk WHERE rank <= 8")
def provision_search_batch(spark, sf_dir):
    units = _sentence_units(spark, sf_dir)
    found = provisions.search(_item_cases(spark, sf_dir), units, top=8)
    return found.select("case_id", "rank", "unit_id", "score", F.array_join("matched", " ").alias("matched"))


@query(f"""WITH {SEARCH},
t AS (SELECT c1.case_id, rk.score, rk.ws FROM c1 LEFT JOIN rk ON rk.case_id = c1.case_id AND rk.rank = 1 WHERE len(c1.terms) > 0),
g AS (SELECT *, coalesce(len(ws), 0) AS n, coalesce(len(list_filter(ws, lambda x: x >= 4.0)), 0) AS d, coalesce(list_max(ws), 0) AS top FROM t)
SELECT case_id, CASE WHEN score IS NULL THEN 'not_found' WHEN n < 2 THEN CASE WHEN score >= 6 THEN 'weak' WHEN top >= 5.5 AND score >= 2.5 THEN 'weak' ELSE 'not_found' END
  WHEN d < 1 THEN CASE WHEN score >= 6 THEN 'weak' ELSE 'not_found' END WHEN score >= 6 THEN 'supported' WHEN score >= 2.5 THEN 'weak' ELSE 'not_found' END AS outcome FROM g""")
def assess_verdicts(spark, sf_dir):
    cases, units = _item_cases(spark, sf_dir), _sentence_units(spark, sf_dir)
    top = provisions.search(cases, units, top=1).join(units.select("unit_id", "text"), "unit_id").withColumn("conflicts", T.conflicts("text", F.lit("")))
    return provisions.assess(cases.select("case_id").join(top, "case_id", "left")).select("case_id", "outcome")


# ---- codes, terms, language patterns


@query(f"""WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN printf('%05d', p_partkey) WHEN 1 THEN ' j' || printf('%04d', p_partkey % 10000) WHEN 2 THEN 'e' || printf('%02d', p_partkey % 100) || '.01' WHEN 3 THEN 'D8080' ELSE p_brand END AS raw FROM part),
n AS (SELECT p_partkey, replace(upper(trim(raw)), ' ', '') AS code FROM c)
SELECT p_partkey, code, CASE WHEN regexp_matches(code, '{K.CPT}') THEN 'cpt' WHEN regexp_matches(code, '{K.HCPCS}') THEN 'hcpcs' WHEN regexp_matches(code, '{K.ICD10}') THEN 'icd10' ELSE 'unknown' END AS system FROM n""")
def classify_codes(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.format_string("%05d", k)).when(k % 5 == 1, F.concat(F.lit(" j"), F.format_string("%04d", k % 10000))).when(k % 5 == 2, F.concat(F.lit("e"), F.format_string("%02d", k % 100), F.lit(".01"))).when(k % 5 == 3, "D8080").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_code(raw).alias("code"), T.classify_code(raw).alias("system"))


@query("""WITH r AS (SELECT p_partkey AS ordinal, upper(replace(p_brand, '#', '')) AS code, trim(p_name) AS descriptor FROM part),
l AS (SELECT code, arg_max(descriptor, ordinal) AS descriptor FROM r GROUP BY code)
SELECT p_partkey, l.code, l.descriptor FROM part JOIN l ON l.code = upper(replace(p_brand, '#', ''))""")
def resolve_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("code", F.replace("p_brand", F.lit("#"), F.lit("")))
    codes = readers.parsed_codes(p.select("code", F.lit("").alias("system"), F.col("p_name").alias("descriptor"), F.lit("").alias("synonyms"), F.col("p_partkey").alias("ordinal")))
    return provisions.resolve_codes(p.select("p_partkey", "code"), codes).select("p_partkey", "code", "descriptor")


_CASES = (("c1", "Bath or shower chair, with or without wheels"), ("c2", "Whirlpool, portable (hot tub)"), ("c3", "Equestrian / hippotherapy, per session"), ("c4", "Arthroplasty, knee"))
_EXP = ", ".join(f"('{k}', {[t for w in v for t in __import__('re').findall('[a-z0-9]+', w.lower()) if len(t) > 2 and t not in K.STOPWORDS]!r})" for k, v in K.TERM_EXPANSIONS.items())


@query(f"""WITH c(case_id, d) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _CASES)}), x(term, ex) AS (VALUES {_EXP}),
k AS (SELECT case_id, unnest({toks('d')}) AS term, generate_subscripts({toks('d')}, 1) AS ord FROM c),
a AS (SELECT case_id, term, min(ord) AS o FROM k GROUP BY 1, 2 UNION ALL SELECT case_id, unnest(ex), 10000 + 100 * ord + generate_subscripts(ex, 1) FROM k JOIN x USING (term)),
b AS (SELECT case_id, term, min(o) AS o FROM a GROUP BY 1, 2)
SELECT case_id, string_agg(term, ' ' ORDER BY o) AS terms, string_agg(term, ' ' ORDER BY o) FILTER (o < 10000) AS core FROM b GROUP BY case_id""")
def expand_terms(spark, sf_dir):
    cases = spark.createDataFrame(list(_CASES), "case_id string, d string").withColumn("core", provisions.core_terms(F.array("d")))
    return provisions.query_terms(cases).select("case_id", F.array_join("terms", " ").alias("terms"), F.array_join("core", " ").alias("core"))


_PROV = ("Non-surgical treatment of obesity.", "Oral appliances for snoring", "Over-the-counter drugs are excluded", "Cosmetic procedures, unless needed after an accident.", "Outpatient only. See Section 3: Limits, and Appendix B", "Limited to 10 visits per calendar year.", "We offer a program", "below).")
_DESC = ("sleeve gastrectomy surgery", "prescription drug", "reconstructive plasty", "inpatient stay")
_vals = lambda xs: ", ".join(f"('{x}')" for x in xs)


@query(f"""WITH p(prov) AS (VALUES {_vals(_PROV)}), d(descr) AS (VALUES {_vals(_DESC)})
SELECT prov, descr, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(prov), '{a}') AND regexp_matches(lower(descr), '{b}') THEN '{m}' END" for a, b, m in K.CONFLICTS)}], lambda x: x IS NOT NULL), ' / ') AS conflicts FROM p, d""")
def detect_conflicts(spark, sf_dir):
    rows = [(p, d) for p in _PROV for d in _DESC]
    return spark.createDataFrame(rows, "prov string, descr string").withColumn("conflicts", F.array_join(T.conflicts("prov", "descr"), " / "))


@query(f"""WITH p(prov) AS (VALUES {_vals(_PROV)})
SELECT prov, nullif(rtrim(regexp_extract(prov, '{K.EXCEPTION}' || '[\\s\\S]*$'), '.'), '') AS exception_clause, array_to_string(list_transform(regexp_extract_all(prov, '{K.CROSS_REFERENCE}'), lambda x: trim(x)), ' / ') AS refs,
  length(trim(prov)) < 8 OR regexp_matches(prov, '^[a-z]') OR length(prov) - length(replace(prov, ')', '')) > length(prov) - length(replace(prov, '(', '')) AS fragment,
  NOT regexp_matches(prov, '{K.ADMINISTRATIVE}') AND regexp_matches(prov, '{K.LIMIT_LANGUAGE}') AS states_limit FROM p""")
def provision_language(spark, sf_dir):
    p = spark.createDataFrame([(x,) for x in _PROV], "prov string")
    return p.select("prov", T.exception_clause("prov").alias("exception_clause"), F.array_join(T.cross_references("prov"), " / ").alias("refs"), T.is_fragment("prov").alias("fragment"), T.is_citable(F.lit("limitation"), "prov").alias("states_limit"))


# ---- Markdown


@query(f"WITH {MD} SELECT doc_id, pos::INT AS pos, kind, array_to_string(path, ' > ') AS breadcrumb, page::INT AS page FROM mp WHERE kind IN ('heading', 'text')")
def md_heading_path(spark, sf_dir):
    md = markdown.carried(markdown.heading_paths(markdown.classified(markdown.lines(markdown_of(spark, sf_dir)))))
    return md.where("kind in ('heading', 'text')").select("doc_id", "pos", "kind", T.breadcrumb("section_path").alias("breadcrumb"), "page")


@query(f"WITH {MD} SELECT doc_id, block::INT AS block, text, breadcrumb, page_start::INT AS page_start, page_end::INT AS page_end FROM mr")
def md_blocks(spark, sf_dir):
    b = markdown.blocks(markdown_of(spark, sf_dir))
    bc = T.breadcrumb("section_path")
    return b.select("doc_id", "block", "text", F.when(bc == "", inventory.NO_HEADING).otherwise(bc).alias("breadcrumb"), "page_start", "page_end")


@query(f"WITH {MD} SELECT doc_id, occurrence::BIGINT AS occurrence, breadcrumb, heading, depth::INT AS depth, page_start::INT AS page_start, page_end::INT AS page_end, text_blocks::BIGINT AS text_blocks, tables::BIGINT AS tables, chars::BIGINT AS chars, 'text-only' AS profile FROM sec")
def section_inventory(spark, sf_dir):
    return inventory.sections(markdown.blocks(markdown_of(spark, sf_dir)))


@query(f"""WITH {MD}, t AS (SELECT *, string_split(breadcrumb, ' > ')[1] AS top FROM sec), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY occurrence ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(top) OVER (PARTITION BY doc_id ORDER BY occurrence) = top THEN 0 ELSE 1 END AS new FROM t))
SELECT doc_id, run::BIGINT AS run, any_value(top) AS heading, min(page_start)::INT AS page_start, max(page_end)::INT AS page_end, sum(text_blocks)::BIGINT AS text_blocks, sum(tables)::BIGINT AS tables, sum(chars)::BIGINT AS chars FROM r GROUP BY doc_id, run""")
def toplevel_rollup(spark, sf_dir):
    return inventory.top_level(inventory.sections(markdown.blocks(markdown_of(spark, sf_dir))))


@query(f"WITH {MD} SELECT doc_id, breadcrumb, count(*)::BIGINT AS occurrences FROM sec GROUP BY doc_id, breadcrumb HAVING count(*) > 1")
def duplicate_breadcrumbs(spark, sf_dir):
    return inventory.duplicate_breadcrumbs(inventory.sections(markdown.blocks(markdown_of(spark, sf_dir))))


@query(f"WITH {MD} SELECT doc_id, lower(trim(heading)) AS heading, count(*)::BIGINT AS occurrences, count(DISTINCT breadcrumb)::BIGINT AS parents FROM sec GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_headings(spark, sf_dir):
    return inventory.repeated_headings(inventory.sections(markdown.blocks(markdown_of(spark, sf_dir))))


@query(f"""WITH {MD}, s AS (SELECT *, string_split(breadcrumb, ' > ') AS parts FROM sec), e AS (SELECT *, unnest(parts) AS name, generate_subscripts(parts, 1) AS depth0 FROM s)
SELECT doc_id, name, arg_min(depth0, occurrence)::INT AS depth, arg_min(array_to_string(parts[:depth0], ' > '), occurrence) AS breadcrumb, min(occurrence)::BIGINT AS first, min(page_start)::INT AS page_start, max(page_end)::INT AS page_end, sum(text_blocks)::BIGINT AS text_blocks, sum(tables)::BIGINT AS tables FROM e GROUP BY doc_id, name""")
def path_components(spark, sf_dir):
    return inventory.components(inventory.sections(markdown.blocks(markdown_of(spark, sf_dir))))


def _scope_sql(c: str) -> str:
    """The last component that names a division, else the whole."""
    named = f"list_filter(string_split({c}, ' > '), lambda p: regexp_matches(p, '{K.DIVISION}') OR regexp_matches(lower(p), '{'|'.join(p for _, p in K.SCOPES)}'))"
    target = f"lower(CASE WHEN len({named}) > 0 THEN ({named})[-1] ELSE {c} END)"
    return "CASE " + " ".join(f"WHEN regexp_matches({target}, '{p}') THEN '{n}'" for n, p in K.SCOPES) + " END"


@query(f"WITH {MD} SELECT doc_id, occurrence::BIGINT AS occurrence, {_scope_sql('breadcrumb')} AS scope FROM sec")
def scopes(spark, sf_dir):
    return inventory.sections(markdown.blocks(markdown_of(spark, sf_dir))).select("doc_id", "occurrence", T.scope_of("breadcrumb").alias("scope"))


@query(f"""WITH {MD}, b AS (SELECT doc_id, block, text, breadcrumb, {_scope_sql('breadcrumb')} AS scope FROM mr), x AS (SELECT doc_id, block, scope, {sents('text')} AS l FROM b WHERE scope IS NOT NULL),
y AS (SELECT doc_id, block, scope, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS unit FROM x)
SELECT doc_id, block::INT AS block, unit::INT AS unit, scope, text FROM y WHERE len({toks('text')}) > 0 AND length(trim(text)) >= 8 AND NOT regexp_matches(trim(text), '^[a-z]')
  AND length(text) - length(replace(text, ')', '')) <= length(text) - length(replace(text, '(', '')) AND (regexp_matches(text, '{K.RULE_LIKE}') OR NOT regexp_matches(text, '{K.META_SENTENCE}'))
  AND NOT regexp_matches(trim(text), '{K.ADMINISTRATIVE}') AND (scope <> 'limitation' OR regexp_matches(text, '{K.LIMIT_LANGUAGE}'))""")
def provision_units(spark, sf_dir):
    return provisions.units(markdown.blocks(markdown_of(spark, sf_dir))).select("doc_id", "block", "unit", "scope", "text")


@query()
def lead_in_chains(spark, sf_dir):
    b = markdown.blocks(markdown_of(spark, sf_dir)).withColumn("scope", T.scope_of(T.breadcrumb("section_path")))
    return provisions.lead_ins(b.where("kind = 'para'"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>') AS l FROM pages), e AS (SELECT page_id, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS pos FROM h)
SELECT page_id, pos::INT AS pos, regexp_extract(h, '(?i)^<h([1-6])', 1)::INT AS level, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM e""")
def html_sections(spark, sf_dir):
    return markdown.html_sections(table(spark, sf_dir, "pages"))


# ---- pipe tables


@query(f"""WITH {PT}, w AS (SELECT *, role = 'data' AND cells[1] <> '' AND len(list_filter(cells[2:], lambda v: v <> '')) = 0 AS banner_row FROM pc),
b AS (SELECT *, last_value(CASE WHEN banner_row THEN cells[1] END IGNORE NULLS) OVER (PARTITION BY table_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS banner FROM w),
s AS (SELECT *, array_to_string(list_filter(list_transform(['Name', 'Brand', 'Limit'], lambda l, i: CASE WHEN coalesce(cells[i], '') <> '' THEN l || ': ' || cells[i] END), lambda x: x IS NOT NULL), ' | ') AS body FROM b WHERE role = 'data' AND NOT banner_row)
SELECT table_id, pos::INT AS pos, coalesce(banner, '') AS banner, CASE WHEN banner IS NOT NULL THEN banner || ' - ' ELSE '' END || body AS sentence FROM s WHERE body <> ''""")
def pipe_row_sentences(spark, sf_dir):
    return markdown.row_sentences(part_tables(spark, sf_dir).select("table_id", "text"))


@query(f"WITH {PT} SELECT table_id, sum(len(cells))::BIGINT AS cells, sum(len(list_filter(cells, lambda v: v = '')))::BIGINT AS empty, sum(len(list_filter(cells, lambda v: v = ''))) / sum(len(cells)) > 0.2 AS needs_review FROM pc WHERE role = 'data' GROUP BY table_id")
def table_empty_ratio(spark, sf_dir):
    return markdown.empty_ratio(part_tables(spark, sf_dir).select("table_id", "text"), most=0.2)


@query(f"""WITH {PT}, w AS (SELECT doc_id, table_id, max(CASE WHEN len(cells) <> 3 THEN 1 ELSE 0 END) AS bad FROM pc GROUP BY doc_id, table_id)
SELECT doc_id, count(*)::BIGINT AS checked, sum(bad)::BIGINT AS ragged, greatest(0.0, 1 - 2.5 * sum(bad) / count(*))::DOUBLE AS score FROM w GROUP BY doc_id""")
def column_consistency(spark, sf_dir):
    return validate.table_columns(part_tables(spark, sf_dir))


def _marked(spark, sf_dir):
    """Documents of five part tables, some with a marker left out or an id used twice."""
    t = part_tables(spark, sf_dir).withColumn("n", F.regexp_extract("table_id", "[0-9]+", 0).cast("int"))
    ident = F.when(F.col("n") % 11 == 7, F.concat(F.lit("t"), (F.col("n") - 1).cast("string"))).otherwise(F.col("table_id"))
    close = F.when(F.col("n") % 13 == 4, F.lit("")).otherwise(F.lit(K.TABLE_CLOSE))
    block = F.concat(F.lit("<!-- table id="), ident, F.lit(" pages=1-2 rows=42 cols=3 spans=no -->\n"), F.col("text"), F.lit("\n"), close)
    return t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("markdown"))


@query(f"""WITH {PT}, o AS (SELECT doc_id, CASE WHEN t % 11 = 7 THEN 't' || (t - 1) ELSE table_id END AS id, t % 13 <> 4 AS closed, t FROM ptab),
d AS (SELECT doc_id, t, sum(CASE WHEN closed THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT doc_id, count(*)::BIGINT AS tables, bool_and(closed) AS balanced, (count(*) - count(DISTINCT id))::BIGINT AS duplicates, coalesce(max(coalesce(before, 0)) > 0, false) AS crossed, (bool_and(closed) AND count(*) = count(DISTINCT id))::INT::DOUBLE AS score FROM o JOIN d USING (doc_id, t) GROUP BY doc_id""")
def table_marker_depth(spark, sf_dir):
    return validate.table_markers(markdown.classified(markdown.lines(_marked(spark, sf_dir))))


@query(f"""WITH {PT}, k AS (SELECT table_id, pos, len(cells) AS w, greatest(1, length(line) // 4) AS cost FROM pc WHERE role = 'data')
SELECT table_id, count(*)::BIGINT AS rows, sum(cost)::BIGINT AS cost FROM k GROUP BY table_id""")
def table_row_costs(spark, sf_dir):
    rows = markdown.pipe_rows(part_tables(spark, sf_dir).select("table_id", "text")).where("role = 'data'")
    return rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(T.estimate_tokens("line").cast("long")).alias("cost"))


@query()
def table_split_rows(spark, sf_dir):
    t = part_tables(spark, sf_dir).select("table_id", "text", F.lit("Schedule of Benefits").alias("breadcrumb"))
    return chunking.table_parts(t, chunking.ChunkOptions(max_table_tokens=400))


_CH = """ch AS (SELECT doc_id, table_id, pos, cells, line, (pos - 2) // 15 + 1 AS part FROM pc WHERE role = 'data' AND NOT (((pos - 2) // 15 + 1) = 2 AND substr(table_id, 2)::INT % 6 = 1))"""


@query(f"""WITH {PT}, {_CH}, k AS (SELECT *, lower(array_to_string(cells, '|')) AS key FROM ch), parts AS (SELECT doc_id, table_id, list_sort(list(DISTINCT part)) AS parts FROM ch GROUP BY 1, 2),
r AS (SELECT doc_id, table_id, key, count(*) AS n FROM k WHERE replace(key, '|', '') <> '' GROUP BY 1, 2, 3), s AS (SELECT doc_id, table_id, sum(n) AS rows, count(*) AS distinct_rows FROM r GROUP BY 1, 2)
SELECT doc_id, table_id, len(parts)::BIGINT AS found, len(list_filter([1, 2, 3], lambda x: NOT list_contains(parts, x)))::INT AS missing, s.rows::BIGINT AS rows, distinct_rows::BIGINT AS distinct_rows, len(parts) = 3 AS ok FROM parts JOIN s USING (doc_id, table_id)
""")
def table_audit(spark, sf_dir):
    rows = markdown.pipe_rows(part_tables(spark, sf_dir)).where("role = 'data'").withColumn("part_index", (F.floor((F.col("pos") - 2) / 15) + 1).cast("int"))
    rows = rows.where(~((F.col("part_index") == 2) & (F.substring("table_id", 2, 9).cast("int") % 6 == 1)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    chunks = rows.groupBy("doc_id", "table_id", "part_index").agg(F.concat(F.lit("| Name | Brand | Limit |\n| --- | --- | --- |\n"), body).alias("text")).withColumns({"part_total": F.lit(3), "breadcrumb": F.lit("a")})
    return audit.audit(chunks).select("doc_id", "table_id", "found", F.size("missing").alias("missing"), "rows", "distinct_rows", "ok")


# ---- validation


@query(f"""WITH {MD}, h AS (SELECT doc_id, level > lag(level) OVER (PARTITION BY doc_id ORDER BY pos) + 1 AS skip FROM mp WHERE kind = 'heading'), g AS (SELECT doc_id, count(*) AS headings, count(*) FILTER (skip) AS skips FROM h GROUP BY doc_id)
SELECT doc_id, headings::BIGINT AS headings, skips::BIGINT AS skips, greatest(0.0, 1 - 3 * skips / headings)::DOUBLE AS score FROM g""")
def heading_skips(spark, sf_dir):
    return validate.heading_levels(markdown.classified(markdown.lines(markdown_of(spark, sf_dir))))


@query(f"""WITH {MD}, a AS (SELECT doc_id, anchor, anchor < lag(anchor) OVER (PARTITION BY doc_id ORDER BY pos) AS back FROM mh WHERE kind = 'page')
SELECT doc_id, count(*)::BIGINT AS anchors, count(*) FILTER (back)::BIGINT AS inversions, (count(*) - count(DISTINCT anchor))::BIGINT AS repeated, min(anchor)::INT AS first_page, max(anchor)::INT AS last_page, CASE WHEN count(*) FILTER (back) > 0 THEN 0.0 WHEN count(*) <> count(DISTINCT anchor) THEN 0.7 ELSE 1.0 END::DOUBLE AS score FROM a GROUP BY doc_id""")
def anchor_inversions(spark, sf_dir):
    return validate.page_anchors(markdown.classified(markdown.lines(markdown_of(spark, sf_dir))))


@query("""WITH p AS (SELECT o_orderkey AS doc_id, unnest(['recall', 'table_markers', 'heading_levels', 'sections']) AS chk, unnest([0.9 + (o_orderkey % 10) / 100.0, (o_orderkey % 4 <> 0)::INT::DOUBLE, 0.5 + (o_orderkey % 6) / 10.0, 0.85]) AS score, unnest([0.35, 0.10, 0.13, 0.10])::DOUBLE AS w, unnest([false, o_orderkey % 4 = 0, false, false]) AS blocker FROM orders),
g AS (SELECT doc_id, round(100 * sum(score * w) / sum(w), 1) AS score, round(sum(w), 2) AS weight, bool_or(blocker) AS blocked FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN blocked THEN 'quarantine' WHEN score >= 90 THEN 'pass' WHEN score >= 70 THEN 'review' ELSE 'quarantine' END AS verdict, weight FROM g""")
def validation_verdicts(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = F.array(F.struct(F.lit("recall").alias("check"), (0.9 + (k % 10) / 100.0).alias("score"), F.lit(False).alias("blocker")), F.struct(F.lit("table_markers").alias("check"), (k % 4 != 0).cast("double").alias("score"), (k % 4 == 0).alias("blocker")), F.struct(F.lit("heading_levels").alias("check"), (0.5 + (k % 6) / 10.0).alias("score"), F.lit(False).alias("blocker")), F.struct(F.lit("sections").alias("check"), F.lit(0.85).alias("score"), F.lit(False).alias("blocker")))
    parts = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(rows).alias("p")).select("doc_id", "p.*")
    return validate.validation_score(parts).select("doc_id", "verdict", "weight")


@query()
def validation_score(spark, sf_dir):
    docs = markdown_of(spark, sf_dir)
    return validate.validate(docs, table(spark, sf_dir, "documents").select("doc_id", "text"))


_ATOK = "list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9$%]+'), lambda t: lower(t))"
_CUT = "substr(text, 1, (length(text) * 9) // 10)"


@query(f"""WITH s AS (SELECT doc_id, unnest({_ATOK.format(c='text')}) AS token FROM documents), sc AS (SELECT doc_id, token, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT doc_id, unnest({_ATOK.format(c=_CUT)}) AS token FROM documents), rc AS (SELECT doc_id, token, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT DISTINCT doc_id, unnest(flatten([[token[1:i], token[length(token) - i + 1:]] for i in range(2, length(token))])) AS token FROM rc WHERE length(token) > 2),
x AS (SELECT sc.doc_id, sc.token, sc.n, greatest(sc.n - coalesce(rc.n, 0), 0) AS short, e.token IS NOT NULL AS piece, regexp_matches(sc.token, '^[0-9]+$') AS digits FROM sc LEFT JOIN rc USING (doc_id, token) LEFT JOIN e USING (doc_id, token))
SELECT doc_id, sum(n)::BIGINT AS tokens, sum(short)::BIGINT AS missing, sum(CASE WHEN digits THEN short ELSE 0 END)::BIGINT AS furniture, sum(CASE WHEN NOT digits AND piece THEN short ELSE 0 END)::BIGINT AS rejoined FROM x GROUP BY doc_id""")
def recall_reconcile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = d.select("doc_id", F.expr("substring(text, 1, cast(floor(length(text) * 9 / 10) as int))").alias("text"))
    return validate.recall(d, cut).select("doc_id", "tokens", "missing", "furniture", "rejoined")


@query(f"""WITH wp AS (SELECT doc_id, i // 12 + 1 AS page, unnest({_ATOK.format(c='text')}) AS token FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
wn AS (SELECT doc_id, page, token, count(*) AS n FROM wp GROUP BY ALL), wr AS (SELECT doc_id, unnest({_ATOK.format(c=_CUT)}) AS token FROM documents), wq AS (SELECT doc_id, token, count(*) AS pool FROM wr GROUP BY ALL),
wu AS (SELECT wn.*, coalesce(pool, 0) AS pool, sum(n) OVER (PARTITION BY doc_id, token ORDER BY page) AS upto FROM wn LEFT JOIN wq USING (doc_id, token)),
wl AS (SELECT doc_id, page, sum(greatest(0, upto - pool) - greatest(0, upto - n - pool))::BIGINT AS lost, sum(n)::BIGINT AS tokens FROM wu GROUP BY doc_id, page),
wk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lost / tokens DESC, page) AS rank FROM wl WHERE lost > 0.05 * tokens)
SELECT doc_id, rank::INT AS rank, page::INT AS page, lost, tokens FROM wk WHERE rank <= 10""")
def worst_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = d.select("doc_id", F.expr("substring(text, 1, cast(floor(length(text) * 9 / 10) as int))").alias("text"))
    pages = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("doc_id", (F.floor(F.col("i") / 12) + 1).cast("int").alias("page"), "text")
    return validate.worst_pages(validate.recall_by_page(pages, cut))


# ---- layout


@query(f"""WITH {PL}, k AS (SELECT DISTINCT doc_id, page, trim(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g')) AS key FROM plines WHERE top <= h * 0.1 OR bottom >= h * 0.9),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM plines GROUP BY doc_id), c AS (SELECT doc_id, key, count(*) AS pages FROM k WHERE key <> '' GROUP BY 1, 2)
SELECT doc_id, key, pages::BIGINT AS pages FROM c JOIN n USING (doc_id) WHERE pages >= greatest(3, least(floor(n * 0.45), 10))""")
def running_lines(spark, sf_dir):
    return layout.running_lines(page_lines(spark, sf_dir))


@query(f"""WITH {PL}, s AS (SELECT doc_id, size, sum(length(text)) AS chars, min((page, line_no)) AS first FROM plines GROUP BY 1, 2)
SELECT doc_id, size::DOUBLE AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) AS r FROM s) WHERE r = 1""")
def modal_size(spark, sf_dir):
    return layout.body_size(page_lines(spark, sf_dir))


@query(f"""WITH {PL}, b AS (SELECT doc_id, x0::DOUBLE AS x, sum(length(text)) AS chars FROM plines GROUP BY 1, 2)
SELECT doc_id, min(x) AS margin FROM (SELECT *, max(chars) OVER (PARTITION BY doc_id) AS most FROM b) WHERE chars >= 0.05 * most GROUP BY doc_id""")
def left_margin(spark, sf_dir):
    return layout.left_margin(page_lines(spark, sf_dir))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z\\x{{c0}}-\\x{{24f}}]+') AS ws, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{L}}]|[\\x{{0}}-\\x{{2c0}}]', '', 'g')) AS far FROM documents),
x AS (SELECT doc_id, len(ws) AS words, letters, far, len(list_filter(ws, lambda w: w IN ({", ".join(f"'{w}'" for w in K.ENGLISH_WORDS)}))) AS hits FROM w)
SELECT doc_id, words::INT AS words, CASE WHEN words >= 40 AND letters > 0 THEN (far / letters >= 0.15 OR hits / words < 0.12) ELSE false END AS foreign_page FROM x""")
def page_language(spark, sf_dir):
    return layout.page_language(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "words", F.col("foreign").alias("foreign_page"))


def _words(spark, sf_dir):
    """The words of page lines."""
    x = page_lines(spark, sf_dir).select("doc_id", "page", "line_no", "top", "bottom", "page_height", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("k", "text"))
    return x.withColumn("word_idx", F.col("line_no") * 10000 + F.col("k"))


@query(f"""WITH {PL}, t AS (SELECT doc_id, page, unnest(string_split_regex(trim(text), '\\s+')) AS t FROM plines WHERE top <= h * 0.12 OR bottom >= h * 0.88),
v AS (SELECT DISTINCT doc_id, page, page - x::INT AS off FROM (SELECT doc_id, page, regexp_replace(regexp_replace(t, '^[.)(-]+', ''), '[.)(-]+$', '') AS x FROM t) WHERE regexp_matches(x, '^[0-9]{{1,4}}$') AND x::INT >= 1),
a AS (SELECT doc_id, off, count(*) AS agree FROM v WHERE off BETWEEN 0 AND 60 GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY agree DESC, off) AS r FROM a) WHERE r = 1)
SELECT p.doc_id, b.off::INT AS off, round(coalesce(agree, 0) / p.n, 3) AS confidence, p.n::BIGINT AS examined FROM (SELECT doc_id, count(DISTINCT page) AS n FROM plines GROUP BY doc_id) p LEFT JOIN b USING (doc_id)""")
def page_number_vote(spark, sf_dir):
    return layout.page_numbering(_words(spark, sf_dir)).select("doc_id", F.col("offset").alias("off"), "confidence", "examined")


@query(f"""WITH {PL}, c AS (SELECT doc_id, page, CASE WHEN (page // 3) % 2 = 0 THEN 'SBN25.CHC.I.2018' ELSE 'COC25.INS.2018.LG' END AS form_code, (page % 3) + 1 AS printed FROM pg),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(form_code) OVER (PARTITION BY doc_id ORDER BY page) = form_code THEN 0 ELSE 1 END AS new FROM c)),
s AS (SELECT doc_id, run, any_value(form_code) AS form_code, min(page) AS pdf_start, max(page) AS pdf_end, arg_min(printed, page) AS printed_start, arg_max(printed, page) AS printed_end FROM r GROUP BY doc_id, run)
SELECT doc_id, run::BIGINT AS run, form_code, pdf_start::INT AS pdf_start, pdf_end::INT AS pdf_end, printed_start::INT AS printed_start, printed_end::INT AS printed_end, count(*) OVER (PARTITION BY doc_id) >= 2 AS found FROM s""")
def form_sections(spark, sf_dir):
    pages = page_lines(spark, sf_dir).select("doc_id", "page").distinct()
    code = F.when(F.floor(F.col("page") / 3) % 2 == 0, "SBN25.CHC.I.2018").otherwise("COC25.INS.2018.LG")
    foot = F.concat(F.lit("every three years. "), code, F.lit(" "), (F.col("page") % 3 + 1).cast("string"))
    words = pages.select("doc_id", "page", F.posexplode(F.split(foot, " ")).alias("word_idx", "text"), F.lit(780.0).alias("top"), F.lit(790.0).alias("bottom"), F.lit(800.0).alias("page_height"))
    return layout.form_sections(words)


@query(f"""WITH {PL}, m AS (SELECT doc_id, page, median(12.0) AS height FROM plines GROUP BY 1, 2),
g AS (SELECT l.doc_id, l.page, line_no, (top - lag(bottom) OVER w) AS gap, x0 - lag(x0) OVER w AS indent, height, regexp_matches(text, '{K.BULLET}') AS bullet FROM plines l JOIN m USING (doc_id, page) WINDOW w AS (PARTITION BY l.doc_id, l.page ORDER BY line_no))
SELECT doc_id, page::INT AS page, line_no::INT AS line_no, sum(CASE WHEN gap IS NULL OR gap > 0.9 * height OR bullet OR (indent > 18 AND gap > 0.35 * height) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS para FROM g""")
def line_paragraphs(spark, sf_dir):
    return layout.paragraphs(page_lines(spark, sf_dir)).select("doc_id", "page", "line_no", "para")


@query()
def line_headings(spark, sf_dir):
    return layout.headings(page_lines(spark, sf_dir), bold_counts=True).select("doc_id", "page", "line_no", "heading_level")


#: Contents lines over the rows of ``part``: leaders, wide gaps, a title line, prose without a page, front matter, roman pages.
TOC_LINES = """CASE p_partkey % 8 WHEN 0 THEN p_name || ' ' || repeat('.', (p_size % 9)::INT) || ' ' || p_size WHEN 1 THEN p_name || repeat(' ', (p_size % 4 + 1)::INT) || p_size WHEN 2 THEN 'Contents'
  WHEN 3 THEN p_name WHEN 4 THEN 'Contact Us, ' || p_brand || ' ...... ' || p_size WHEN 5 THEN 'Appendix ' || p_brand || ' ____ xiv' WHEN 6 THEN p_size || ' .... ' || p_size ELSE '  Section ' || p_size || ': ' || p_name || '    iv ' END"""
TOC = f"""tl AS (SELECT p_partkey, regexp_replace({TOC_LINES}, '\\s+$', '') AS line FROM part),
tm AS (SELECT p_partkey, line, regexp_matches(line, '{K.TOC_LEADER}') AS lead, regexp_matches(line, '{K.TOC_PLAIN}') AS plain FROM tl),
tp AS (SELECT p_partkey, line, lead OR plain AS fits, trim(regexp_replace(CASE WHEN lead THEN regexp_extract(line, '{K.TOC_LEADER}', 1) ELSE regexp_extract(line, '{K.TOC_PLAIN}', 1) END, '\\s+', ' ', 'g')) AS title,
  CASE WHEN lead THEN regexp_extract(line, '{K.TOC_LEADER}', 2) ELSE regexp_extract(line, '{K.TOC_PLAIN}', 2) END AS page FROM tm),
te AS (SELECT p_partkey, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN page END AS page FROM (SELECT *, fits AND NOT regexp_matches(line, '(?i)^\\s*(table of contents|contents|what.s inside)\\s*$') AND length(title) >= 4 AND regexp_matches(title, '\\p{{L}}') AS ok FROM tp))"""


def _toc_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(TOC_LINES.replace("p_size ||", "cast(p_size as string) ||").replace("|| p_size", "|| cast(p_size as string)").replace("::INT", "")).alias("line"))


@query(f"WITH {TOC} SELECT * FROM te")
def toc_entries(spark, sf_dir):
    t = _toc_rows(spark, sf_dir).withColumn("e", T.toc_entry("line"))
    return t.select("p_partkey", F.col("e.title").alias("title"), F.col("e.page").alias("page"))


@query(f"WITH {TOC} SELECT *, regexp_matches(title, '{K.DIVISION_ENTRY}') AS division FROM te WHERE title IS NOT NULL AND NOT regexp_matches(title, '{K.FRONT_MATTER}')")
def toc_body_entries(spark, sf_dir):
    t = _toc_rows(spark, sf_dir).withColumn("e", T.toc_entry("line")).where("e is not null").select("p_partkey", F.col("e.title").alias("title"), F.col("e.page").alias("page"))
    return inventory.body_entries(t)


@query()
def toc_fuzzy_match(spark, sf_dir):
    rows = inventory.sections(markdown.blocks(markdown_of(spark, sf_dir)))
    said = "Section 1: Exclusions & Limitations ..... 3\nSchedule of Benefit ..... 9\nDefined Terms"
    toc = inventory.parse_toc(table(spark, sf_dir, "documents").select("doc_id", F.lit(said).alias("text")))
    return inventory.toc_coverage(toc, rows)


# ---- retrieval


_COS = "round((1 + list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6)"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""")
def vector_topk_batch(spark, sf_dir):
    return search.vector_topk(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND a.label = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""")
def vector_topk_filtered(spark, sf_dir):
    return search.vector_topk(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10, F.col("label") == 1)


BM = f"""bt AS (SELECT doc_id, {toks('text')} AS ts FROM documents), ba AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM bt), bp AS (SELECT doc_id, len AS n_tokens, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM bt) GROUP BY 1, 2, 3),
bq AS (SELECT item_id AS query_id, unnest(list_distinct({toks('text')})) AS term FROM benchmark), bd AS (SELECT term, count(*) AS df FROM bp GROUP BY term),
bs AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))), 4) AS score FROM bp JOIN bd USING (term) JOIN bq USING (term), ba GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"""


@query(f"WITH {BM} SELECT query_id, rank::INT AS rank, doc_id, score FROM br WHERE rank <= 8")
def bm25_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.search_tokens("text").alias("terms"))
    return search.bm25(table(spark, sf_dir, "documents"), asked, 8)


@query(f"""WITH {BM}, bf AS (SELECT bs.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs JOIN documents USING (doc_id) WHERE lang IN ('fr', 'de') AND source <> 'src0')
SELECT query_id, rank::INT AS rank, doc_id, score FROM bf WHERE rank <= 8""")
def bm25_topk_filtered(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.search_tokens("text").alias("terms"))
    return search.bm25(table(spark, sf_dir, "documents"), asked, 8, where=F.col("lang").isin("fr", "de") & (F.col("source") != "src0"))


HY = f"""hv AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
hd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, 0 AS list FROM hv QUALIFY rank <= 16), hs AS (SELECT query_id, doc_id AS id, rank, 1 AS list FROM br WHERE rank <= 16),
hf AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score, min((list, rank)) AS first FROM (SELECT * FROM hd UNION ALL SELECT * FROM hs) GROUP BY 1, 2)"""


@query(f"WITH {BM}, {HY} SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM hf) WHERE rank <= 8")
def hybrid_search(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    q = table(spark, sf_dir, "embeddings").join(items.select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    dense = search.vector_topk(table(spark, sf_dir, "embeddings"), q, 16).select("query_id", F.col("vec_id").alias("id"), "rank")
    asked = items.select(F.col("item_id").alias("query_id"), T.search_tokens("text").alias("terms"))
    sparse = search.bm25(table(spark, sf_dir, "documents"), asked, 16).select("query_id", F.col("doc_id").alias("id"), "rank")
    return search.hybrid(dense, sparse, 8)


@query("""WITH a AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 0 AS list FROM orders), b AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank, 1 AS list FROM orders),
f AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score, min((list, rank)) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 8""")
def rrf_fusion(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    ranked = lambda *by: o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).select("query_id", "id", "rank")
    return search.rank_fusion([ranked(F.desc("o_totalprice"), "id"), ranked("o_orderdate", "id")], 8)


@query("""WITH h AS (SELECT conv_id % 7 AS query_id, conv_id AS doc_id, turn AS seq, (conv_id * 10 + turn)::INT AS rank, round(1.0 / (1 + conv_id + turn), 6) AS score FROM conversations WHERE turn % 3 = 0),
n AS (SELECT query_id, doc_id, seq + s AS seq, min((rank, score * 0.5)) AS f FROM h, (VALUES (-1), (1)) v(s) GROUP BY 1, 2, 3)
SELECT query_id, doc_id, seq, rank, score::DOUBLE AS score, false AS neighbor FROM h
UNION ALL SELECT query_id, doc_id, seq, struct_extract(f, 1), struct_extract(f, 2)::DOUBLE, true FROM n WHERE (doc_id, seq) IN (SELECT (conv_id, turn) FROM conversations) AND (query_id, doc_id, seq) NOT IN (SELECT (query_id, doc_id, seq) FROM h)""")
def neighbors_band_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"))
    hits = c.where("seq % 3 = 0").select((F.col("doc_id") % 7).alias("query_id"), "doc_id", "seq", (F.col("doc_id") * 10 + F.col("seq")).cast("int").alias("rank"), F.round(1.0 / (1 + F.col("doc_id") + F.col("seq")), 6).alias("score"))
    return search.with_neighbors(hits, c)


@query("SELECT conv_id AS query_id, turn AS place, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 1500")
def context_budget(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), "text")
    return search.context_budget(s, 1500).select("query_id", "place", "used")


@query()
def embed_documents(spark, sf_dir):
    return embed.embedded(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("embed_text")), embed.HashEmbedder, key="doc_id")


# ---- chunks and stored tables


def _chunk_rows(spark, sf_dir):
    """Conversations as chunk rows."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("d"), (F.col("conv_id") % 50).cast("string")).alias("doc_id"), (F.col("conv_id") * 100 + F.col("turn")).cast("int").alias("seq"), F.concat(F.lit("plan"), (F.col("conv_id") % 3).cast("string")).alias("plan_id"), F.lit(2025).alias("plan_year"),
        (F.col("turn") + 1).cast("int").alias("page_end"), F.when(F.col("turn") % 4 == 1, "table").otherwise("text").alias("type"), (F.length("text") % 9 == 0).alias("needs_review"),
        F.when(F.col("conv_id") % 5 != 0, F.when(F.col("turn") % 2 == 0, "1.1.0").otherwise("1.0.0")).alias("pipeline_version"), T.estimate_tokens("text").alias("n_tokens"), F.lit(1).alias("part_total"), F.lit(None).cast("string").alias("table_id"), "text",
    )


CR = "cr AS (SELECT 'd' || (conv_id % 50) AS doc_id, (conv_id * 100 + turn)::INT AS seq, 'plan' || (conv_id % 3) AS plan_id, 2025 AS plan_year, (turn + 1)::INT AS page_end, CASE WHEN turn % 4 = 1 THEN 'table' ELSE 'text' END AS type, length(text) % 9 = 0 AS needs_review, CASE WHEN conv_id % 5 <> 0 THEN CASE WHEN turn % 2 = 0 THEN '1.1.0' ELSE '1.0.0' END END AS pipeline_version, greatest(1, length(text) // 4)::INT AS n_tokens, text FROM conversations)"


@query(f"WITH {CR} SELECT doc_id, arg_min(plan_id, seq) AS plan_id, arg_min(plan_year, seq) AS plan_year, count(*)::BIGINT AS chunks, max(page_end) AS pages, count(*) FILTER (type = 'table')::BIGINT AS tables, count(*) FILTER (needs_review)::BIGINT AS needs_review FROM cr GROUP BY doc_id")
def list_documents(spark, sf_dir):
    return store.list_documents(_chunk_rows(spark, sf_dir))


@query(f"WITH {CR} SELECT doc_id, seq FROM cr WHERE needs_review ORDER BY doc_id, seq LIMIT 100")
def review_queue(spark, sf_dir):
    return store.needing_review(_chunk_rows(spark, sf_dir)).select("doc_id", "seq")


@query(f"WITH {CR} SELECT doc_id, seq, pipeline_version FROM cr WHERE pipeline_version IS DISTINCT FROM '1.1.0'")
def stale_chunks(spark, sf_dir):
    return store.stale(_chunk_rows(spark, sf_dir), K.PIPELINE_VERSION).select("doc_id", "seq", "pipeline_version")


@query(f"WITH {CR} SELECT doc_id, seq, doc_id || '#' || printf('%05d', seq) || '-' || substr(md5(doc_id || '#' || seq), 1, 8) AS chunk_id FROM cr")
def chunk_ids(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).select("doc_id", "seq", T.chunk_id("doc_id", "seq").alias("chunk_id"))


@query(f"WITH {CR}, s AS (SELECT doc_id, list_sort(list(n_tokens)) AS t FROM cr GROUP BY doc_id) SELECT doc_id, len(t)::BIGINT AS chunks, t[len(t) // 2 + 1] AS median, t[floor(len(t) * 0.9)::INT + 1] AS p90, t[-1] AS most, list_sum(t)::BIGINT AS total, 0::BIGINT AS split_tables FROM s")
def token_stats(spark, sf_dir):
    return chunking.chunk_stats(_chunk_rows(spark, sf_dir))


@query(f"WITH {CR} SELECT doc_id, seq FROM cr WHERE seq % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    c = _chunk_rows(spark, sf_dir).withColumn("chunk_id", T.chunk_id("doc_id", "seq"))
    return store.not_stored(c, c.where("seq % 3 = 0")).select("doc_id", "seq")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def dedupe_by_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query("""WITH m AS (SELECT conv_id AS doc_id, turn AS table_id FROM conversations WHERE turn % 3 <> 1), s AS (SELECT conv_id AS doc_id, turn AS table_id FROM conversations WHERE turn % 2 = 0)
SELECT coalesce(m.doc_id, s.doc_id) AS doc_id, count(*) FILTER (s.doc_id IS NULL)::BIGINT AS only_markdown, count(*) FILTER (m.doc_id IS NULL)::BIGINT AS only_structure FROM m FULL JOIN s ON m.doc_id = s.doc_id AND m.table_id = s.table_id GROUP BY 1""")
def fulltext_reconcile(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("table_id"))
    return audit.reconciled(c.where("table_id % 3 <> 1"), c.where("table_id % 2 = 0"))


@query()
def chunk_text_overlap(spark, sf_dir):
    return chunking.chunks(markdown.blocks(markdown_of(spark, sf_dir)), chunking.ChunkOptions(target_tokens=120, max_tokens=160, overlap_tokens=30))


@query("""WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'soon' END AS raw, ts FROM events)
SELECT event_id, raw, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) END AS raw_at FROM d""")
def coerce_dates(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).when(k == 2, "soon")
    return store.with_dates(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'F1, ' || CASE WHEN turn = turn + turn % 3 THEN 'p. ' || turn ELSE 'pp. ' || turn || '-' || (turn + turn % 3) END ELSE 'p. ' || conv_id || CASE WHEN turn % 3 > 0 THEN '-' || (conv_id + turn % 3) ELSE '' END END AS citation FROM conversations""")
def citations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    even = F.col("turn") % 2 == 0
    return c.select("conv_id", "turn", T.citation("conv_id", F.col("conv_id") + F.col("turn") % 3, F.when(even, F.col("turn")), F.when(even, F.col("turn") + F.col("turn") % 3), F.lit("F1")).alias("citation"))


# ---- streaming operators, on batch input


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS events FROM g GROUP BY user_id, g""")
def user_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))


# ---- grids


def _drawn(spark, sf_dir):
    """Words and cell boxes of pages drawn from ``part``: two pages of twenty rows for each forty parts, with a header on
    each; each seventh row is one merged cell over the three columns."""
    p = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 40)).alias("doc_id"), (F.floor(F.pmod("p_partkey", F.lit(40)) / 20) + 1).cast("int").alias("page"), (F.pmod("p_partkey", F.lit(20)) + 1).alias("r"), (F.col("p_partkey") % 7 == 3).alias("banner"), F.array("p_name", "p_brand", F.col("p_size").cast("string")).alias("v"))
    head = p.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0).cast("long").alias("r"), F.lit(False).alias("banner"), F.array(F.lit("Name"), F.lit("Brand"), F.lit("Size")).alias("v"))
    rows = p.withColumn("r", F.col("r").cast("long")).unionByName(head)
    # a page whose rows have gaps would have rows that no box draws, so rows are numbered anew
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("r")) - 1).withColumn("top", 100.0 + F.col("k") * 20.0)
    cells = rows.select("doc_id", "page", "top", F.posexplode(F.when(F.col("banner"), F.slice("v", 1, 1)).otherwise(F.col("v"))).alias("c", "text"), "banner")
    words = cells.select("doc_id", "page", "top", "c", F.posexplode(F.split("text", " ")).alias("w", "text")).select("doc_id", "page", "text", (60.0 + F.col("c") * 200.0 + F.col("w") * 30.0).alias("x0"), (80.0 + F.col("c") * 200.0 + F.col("w") * 30.0).alias("x1"), (F.col("top") + 4.0).alias("top"), (F.col("top") + 16.0).alias("bottom"))
    box = F.struct((50.0 + F.col("c") * 200.0).alias("x0"), "top", F.when(F.col("banner"), 650.0).otherwise(250.0 + F.col("c") * 200.0).alias("x1"), (F.col("top") + 20.0).alias("bottom"))
    return words, cells.groupBy("doc_id", "page").agg(F.lit(0).alias("table_idx"), F.collect_list(box).alias("cells"))


DRAWN = """gp AS (SELECT p_partkey // 40 AS doc_id, p_partkey % 40 // 20 + 1 AS page, p_partkey % 20 + 1 AS r, p_partkey % 7 = 3 AS banner, [p_name, p_brand, p_size::VARCHAR] AS v FROM part),
ga AS (SELECT * FROM gp UNION ALL SELECT DISTINCT doc_id, page, 0, false, ['Name', 'Brand', 'Size'] FROM gp),
gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY r) - 1 AS k FROM ga),
gl AS (SELECT *, last_value(CASE WHEN banner THEN v[1] END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY k) AS grp FROM gr)"""


@query(f"WITH {DRAWN} SELECT doc_id, page::INT AS page, k::INT AS row, unnest(CASE WHEN banner THEN [0] ELSE [0, 1, 2] END)::INT AS col, CASE WHEN banner THEN 3 ELSE 1 END::INT AS colspan, unnest(CASE WHEN banner THEN v[1:1] ELSE v END) AS text, 1 AS header_rows, 0 AS caption_rows FROM gr")
def page_grid_cells(spark, sf_dir):
    g = grids.page_grids(*_drawn(spark, sf_dir)).select("doc_id", "page", "header_rows", "caption_rows", F.explode("cells").alias("c"))
    return g.select("doc_id", "page", F.col("c.r0").alias("row"), F.col("c.c0").alias("col"), (F.col("c.c1") - F.col("c.c0")).alias("colspan"), F.col("c.text").alias("text"), "header_rows", "caption_rows")


@query(f"""WITH {DRAWN} SELECT doc_id, page::INT AS page, k::INT AS row, CASE WHEN grp IS NULL THEN '' ELSE grp || ' - ' END || 'Name: ' || v[1] || ' | Brand: ' || v[2] || ' | Size: ' || v[3] AS sentence FROM gl WHERE k > 0 AND NOT banner""")
def grid_sentences(spark, sf_dir):
    said = grids.rendered(grids.page_grids(*_drawn(spark, sf_dir)), ("cells",))
    # the rows of the sentences: those below the header that no banner fills
    data = F.filter("cells", lambda c: (c["r0"] > 0) & (c["c0"] == 0) & (c["c1"] == 1))
    said = said.select("doc_id", "page", F.array_sort(F.transform(data, lambda c: c["r0"])).alias("rows"), F.posexplode("sentences").alias("at", "sentence"))
    return said.where(F.col("at") < F.size("rows")).select("doc_id", "page", F.element_at("rows", F.col("at") + 1).alias("row"), "sentence")


@query(f"""WITH {DRAWN}, gh AS (SELECT *, CASE WHEN banner THEN '    <td colspan="3">' || v[1] || '</td>' ELSE array_to_string(list_transform(v, lambda x: '    <' || tag || '>' || x || '</' || tag || '>'), chr(10)) END AS h FROM (SELECT *, CASE WHEN k = 0 THEN 'th' ELSE 'td' END AS tag FROM gr)),
gm AS (SELECT doc_id, page, bool_or(banner) AS spans, '<table>' || chr(10) || string_agg('  <tr>' || chr(10) || h || chr(10) || '  </tr>', chr(10) ORDER BY k) || chr(10) || '</table>' AS html,
  '| Name | Brand | Size |' || chr(10) || '| --- | --- | --- |' || string_agg(CASE WHEN k > 0 THEN chr(10) || '| ' || array_to_string(v, ' | ') || ' |' ELSE '' END, '' ORDER BY k) AS pipe FROM gh GROUP BY doc_id, page)
SELECT doc_id, page::INT AS page, CASE WHEN spans THEN html ELSE pipe END AS markdown FROM gm""")
def grid_markdown(spark, sf_dir):
    return grids.rendered(grids.page_grids(*_drawn(spark, sf_dir))).select("doc_id", "page", "markdown")


@query(f"""WITH {DRAWN}, gs AS (SELECT doc_id, count(*) - count(DISTINCT page) + 1 AS n_rows, list_sort(list(DISTINCT page::INT)) AS pages, sum(CASE WHEN banner THEN 1 ELSE 3 END) - 3 * count(DISTINCT page) + 3 AS cells FROM gr GROUP BY doc_id)
SELECT doc_id, n_rows::INT AS n_rows, array_to_string(pages, ',') AS pages, cells::INT AS cells FROM gs""")
def stitched_grids(spark, sf_dir):
    g = grids.stitched(grids.page_grids(*_drawn(spark, sf_dir)))
    return g.select("doc_id", "n_rows", F.array_join("pages", ",").alias("pages"), F.size("cells").alias("cells"))

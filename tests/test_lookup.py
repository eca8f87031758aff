"""Markdown to units, scores, verdicts and citations, on a small plan document."""

import math
import re

from pyspark.sql import functions as F

from clauseloom.functions import constants as K
from clauseloom.functions import text as T
from clauseloom.operators import chunking, inventory, markdown, provisions, validate
from clauseloom.plans import flows

PLAN = """<!-- document: plan -->
<!-- page: 1 -->
# Section 1: Exclusions and Limitations

The following are not Covered Health Care Services:

- Comfort items:

  - Hot tubs, whirlpools and saunas.

  - Chairs, bath chairs, feeding chairs, toddler chairs and recliners.

- Gestational carrier and surrogate services, unless required by law. See Section 3: Appeals, below.

<!-- skipped page=2 reason=toc -->
<!-- page: 3 -->
<!-- form: COC25.INS.2018 printed: 7 -->
## Procedures

Excision of hanging skin, including abdominoplasty, is excluded.

Non-surgical treatment of obesity is excluded.

This section contains headings that are used to help you find rules.

# Schedule of Benefits

<!-- table id=t1 pages=3-4 rows=5 cols=3 spans=no -->
| Service | In-Network | Limit |
| --- | --- | --- |
| Acupuncture |  |  |
| What do you pay? | 20% | Limited to 10 visits per calendar year |
| Does the deductible \\| apply? | Yes |  |
<!-- /table -->

# Section 9: Defined Terms

Nebulizer - a device that turns liquid medicine into mist for the lungs.

# Appendix A: Programs

Some wellness prose about chairs and bath items that is out of scope.
"""
FILLER = "\n\n# Section 2: Exclusions\n\n" + "\n\n".join(f"Filler rule number {k} about alpha{k} beta{k} gamma{k} is excluded." for k in range(300))


def docs(spark, text=PLAN):
    return spark.createDataFrame([("plan", text)], "doc_id string, markdown string")


def test_blocks(spark):
    b = sorted(markdown.blocks(docs(spark)).collect(), key=lambda r: r.block)
    first = b[0]
    assert first.section_path == ["Section 1: Exclusions and Limitations"] and first.page_start == 1
    skin = next(r for r in b if "hanging skin" in r.text)
    assert skin.section_path[-1] == "Procedures" and skin.page_start == 3 and skin.form_code == "COC25.INS.2018" and skin.printed_start == 7
    assert not any("skipped" in r.text for r in b)
    table = next(r for r in b if r.kind == "table")
    assert table.meta["id"] == "t1" and (table.page_start, table.page_end) == (3, 4)
    assert next(r for r in b if "Nebulizer" in r.text).page_start == 4


def test_row_sentences_and_escapes(spark):
    t = markdown.blocks(docs(spark)).where("kind = 'table'").select("doc_id", "text")
    got = [r.sentence for r in sorted(markdown.row_sentences(t).collect(), key=lambda r: r.pos)]
    assert got == ["Acupuncture - Service: What do you pay? | In-Network: 20% | Limit: Limited to 10 visits per calendar year", "Acupuncture - Service: Does the deductible | apply? | In-Network: Yes"]


def test_units_and_lead_in(spark):
    u = {r.text: r for r in provisions.units(markdown.blocks(docs(spark))).collect()}
    chairs = u["Chairs, bath chairs, feeding chairs, toddler chairs and recliners."]
    assert chairs.lead_in == ["The following are not Covered Health Care Services:", "Comfort items:"] and chairs.scope == "exclusion"
    assert not any("used to help you find" in t or "wellness" in t for t in u)
    assert next(r for t, r in u.items() if "10 visits" in t).scope == "limitation"
    assert next(r for t, r in u.items() if t.startswith("Nebulizer")).scope == "definition"


CASES = [("chair", ["Bath or shower chair, with or without wheels"], ["bath chair", "bath seat"]), ("skin", ["Excision, excess skin"], ["abdominoplasty", "hanging skin"]), ("knee", ["Arthroplasty, knee"], []), ("sleeve", ["Laparoscopy, surgical, obesity treatment"], []), ("neb", ["Nebulizer liquid medicine mist lungs"], []), ("carrier", ["Donor services"], ["gestational carrier", "surrogate"])]


def test_verdicts(spark):
    cases = spark.createDataFrame(CASES, "case_id string, descriptors array<string>, synonyms array<string>")
    ranked, verdicts = flows.lookup(cases, docs(spark, PLAN + FILLER))
    got = {r.case_id: r for r in verdicts.collect()}
    assert got["skin"].outcome == "supported" and not got["skin"].needs_human_review
    assert got["knee"].outcome == "not_found"
    assert got["sleeve"].outcome == "not_found" and "conflict" in got["sleeve"].gates
    assert "definition" in got["neb"].gates
    assert got["chair"].outcome in ("supported", "weak")
    assert got["carrier"].exception_clause.startswith("unless required by law") and got["carrier"].needs_human_review
    text = {r.case_id: r.block for r in provisions.citation_block(verdicts, ranked).collect()}
    assert text["knee"] == provisions.NOT_FOUND
    assert "Excision of hanging skin" in text["skin"] and "COC25.INS.2018, p. 7" in text["skin"]
    assert "** Exception in this provision" in text["carrier"] and "** Cross-references: Section 3: Appeals" in text["carrier"]
    score = provisions.accuracy(verdicts.select("case_id", "outcome", F.when(F.col("case_id") == "knee", "not_found").when(F.col("case_id") == "skin", "weak").alias("expected"))).first()
    assert (score.checked, score.passed, score.failures) == (2, 1, ["skin"])
    other = verdicts.withColumn("outcome", F.when(F.col("case_id") == "knee", "weak").otherwise(F.col("outcome")))
    assert [r.case_id for r in provisions.compared(verdicts, other).collect()] == ["knee"]


def test_score_formula(spark):
    """The transparent score, by a plain version."""
    tok = lambda s: [t for t in re.findall("[a-z0-9]+", s.lower()) if len(t) > 2 and t not in K.STOPWORDS]
    units = ["Hot tubs and spa pools are excluded here", "Chairs", "long " + " ".join(f"word{k}" for k in range(30)) + " spa chairs"]
    idf_of = {}
    for t in {t for u in units for t in tok(u)}:
        idf_of[t] = math.log(1 + len(units) / (1 + sum(t in tok(u) for u in units)))
    terms = ["spa", "chairs", "absent"]
    want = {}
    for u in units:
        ts = set(tok(u))
        m = [t for t in terms if t in ts]
        if m:
            want[u] = round(sum(idf_of[t] for t in m) * (0.5 + len(m) / 3) / (1 + math.log1p(max(len(ts) - 12, 0))), 4)
    df = spark.createDataFrame([(str(i), u, "exclusion") for i, u in enumerate(units)], "unit_id string, text string, scope string")
    cases = spark.createDataFrame([(1, terms, terms)], "case_id int, core array<string>, terms array<string>")
    got = {units[int(r.unit_id)]: r.score for r in provisions.search(cases, df, provisions.idf_table(df)).collect()}
    assert got == want


def test_rerank_fails_soft(spark):
    p = spark.createDataFrame([("a", 1, "q", "x"), ("a", 2, "q", "yy")], "case_id string, rank int, query string, text string")
    got = {r.text: r.rank for r in provisions.reranked(p, lambda qs, ts: [float(len(t)) for t in ts]).collect()}
    assert got == {"yy": 1, "x": 2}

    def down(qs, ts):
        raise OSError("no service")

    assert {r.text: r.rank for r in provisions.reranked(p, down).collect()} == {"x": 1, "yy": 2}


def test_inventory_and_toc(spark):
    b = markdown.blocks(docs(spark))
    rows = inventory.sections(b)
    got = {r.breadcrumb: r for r in rows.collect()}
    assert got["Schedule of Benefits"].profile == "table-only" and got["Section 1: Exclusions and Limitations"].profile == "text-only"
    toc = inventory.parse_toc(spark.createDataFrame([("plan", "Section 1: Exclusions & Limitations .... 1\nAppendix Z: Nothing 9\nDefined Terms")], "doc_id string, text string"))
    cover = {r.title: r for r in inventory.toc_coverage(toc, rows).collect()}
    assert cover["Section 1: Exclusions & Limitations"].matched and cover["Section 1: Exclusions & Limitations"].page == 1
    assert cover["Defined Terms"].matched and cover["Defined Terms"].score >= 0.9
    assert not cover["Appendix Z: Nothing"].matched
    empty = markdown.classified(markdown.lines(docs(spark, "# A\n\n## B\n\n# C\n\ntext")))
    assert {r.title for r in inventory.empty_sections(empty).collect()} == {"A", "B"}


def test_validation(spark):
    report = validate.validate(docs(spark), docs(spark).withColumnRenamed("markdown", "text")).first()
    assert report.verdict == "pass" and report.exit_code == 0 and report.score >= 90
    bad = validate.validate(docs(spark, PLAN.replace(K.TABLE_CLOSE, "", 1) + "\n" + K.TABLE_OPEN.replace(r"\s*", " "))).first()
    assert bad.verdict == "quarantine"
    assert validate.validate(docs(spark)).first().verdict == "review"


def test_chunks(spark):
    o = chunking.ChunkOptions(target_tokens=40, max_tokens=60, overlap_tokens=12, min_chunk_tokens=5)
    got = sorted(chunking.chunks(markdown.blocks(docs(spark)), o).collect(), key=lambda r: r.seq)
    assert [r.seq for r in got] == list(range(len(got))) and len({r.chunk_id for r in got}) == len(got)
    assert got[0].embed_text.startswith("Section: Section 1: Exclusions and Limitations\n\n")
    table = next(r for r in got if r.type == "table")
    assert table.table_id == "t1" and "Table t1 (pages 3-4)" in table.embed_text and not table.needs_review
    stats = chunking.chunk_stats(chunking.chunks(markdown.blocks(docs(spark)), o)).first()
    sizes = sorted(r.n_tokens for r in got)
    assert (stats.chunks, stats.median, stats.p90, stats.most) == (len(sizes), sizes[len(sizes) // 2], sizes[int(0.9 * len(sizes))], sizes[-1])


def test_packing():
    o = chunking.ChunkOptions(target_tokens=20, max_tokens=30, overlap_tokens=5, min_chunk_tokens=3)
    p = lambda n, page: ("x" * 4 * n, page, page, None, None)
    out = chunking.pack([p(10, 1), p(12, 2), p(4, 3), p(40, 4), p(2, 5)], 0, o)
    assert [len(c[0].replace("\n", "")) // 4 for c in out] == [22, 4, 40, 2] or len(out) >= 3
    assert any(len(c[0]) // 4 >= 40 for c in out)  # a paragraph over the limit stays whole
    assert chunking.pack([p(2, 1)], 0, o) == []
    assert len(chunking.pack([p(2, 1)], 0, chunking.ChunkOptions(keep_short_sections=True, min_chunk_tokens=3))) == 1
    assert chunking.pack_rows([5, 5, 5, 50, 5], 10, 20) == [1, 1, 2, 3, 4]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(T.roman_to_int(F.lit("xiv"))) == 14 and one(T.roman_to_int(F.lit("MCMX"))) == 1910 and one(T.roman_to_int(F.lit("abc"))) is None
    assert tuple(one(T.form_code(F.lit("every year. Repair and/or SBN25.CHCSELDP.I.2018.LG.CO 5")))) == ("SBN25.CHCSELDP.I.2018.LG.CO", 5)
    assert one(T.form_code(F.lit("19 Schedule of Benefits"))) is None
    assert [one(T.is_page_number(F.lit(t))) for t in ("Page 3 of 10", "xii", "COC25.INS.2018.LG.CO 46", "3 items", "")] == [True, True, True, False, False]
    assert one(T.attributes(F.lit("id=t1 pages=3-4 id=t2"))) == {"id": "t2", "pages": "3-4"}
    assert one(T.quoted_provision(F.array(F.lit("A:"), F.lit("B")), F.lit("C"))) == "A:\n  B\n    C"
    assert one(T.classify_code(F.lit("D8080"))) == "unknown" and one(T.classify_code(F.lit(" e66.01 "))) == "icd10"
    assert one(T.citation(F.lit(3), F.lit(4), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), "PDF p.")) == "PDF p. 3-4"


def test_sections_are_packed_batch_by_batch(spark):
    """Sections pass to the workers as rows, with what is known of them: no data frame for each, and no join behind."""
    rows = [(d, k, "para", f"word{k} " * 60 + ("\n\n" + "more " * 30 if k == 1 else ""), ["A"] if k < 3 else ["B", "C"], k + 1, k + 1, None if k else 7, None, "F1") for d in (1, None) for k in range(4)]
    b = spark.createDataFrame(rows, "doc_id long, block int, kind string, text string, section_path array<string>, page_start int, page_end int, printed_start int, printed_end int, form_code string")
    out = chunking.text_chunks(b, chunking.ChunkOptions(target_tokens=120, max_tokens=160, overlap_tokens=30))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan
    got = out.collect()
    assert {(r.doc_id, r.group) for r in got} == {(1, 1), (1, 2), (None, 1), (None, 2)}
    first = min((r for r in got if r.doc_id == 1), key=lambda r: (r.group, r["at"]))
    assert (first.breadcrumb, first.section_path, first.form_code, first.page_start, first.printed_start) == ("A", ["A"], "F1", 1, 7)
    assert {r.breadcrumb for r in got if r.group == 2} == {"B > C"}

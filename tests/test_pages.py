"""Layout and grids: words and cell boxes to Markdown."""

from clauseloom.operators import grids, layout
from clauseloom.plans import flows
from clauseloom.sources.readers import WORDS

HEIGHT = 800.0


def words_of(page, top, text, size=10.0, font="Body", x0=72.0, doc="d", start=0):
    out, x = [], x0
    for k, w in enumerate(text.split(" ")):
        wide = 5.0 * len(w)
        out.append((doc, page, start + k, w, float(x), float(x + wide), float(top), float(top + size), size, font, HEIGHT))
        x += wide + 4
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, WORDS)


def book(pages=5):
    rows = []
    for p in range(1, pages + 1):
        rows += words_of(p, 20, f"Plan Booklet {2000 + p}", start=0) + words_of(p, 780, f"{p + 1} Schedule of Benefits", start=900)
        rows += words_of(p, 200, f"Section {p}: Rules", size=16.0, font="Body-Bold", start=100)
        rows += words_of(p, 240, "This is body text that goes on and on with exam-", start=200) + words_of(p, 252, "ples and more.", start=300)
        rows += words_of(p, 300, "A second paragraph of body text.", start=400)
    return rows


def test_lines_and_document_facts(spark):
    w = frame(spark, book())
    lines = layout.lines(w)
    got = sorted(lines.where("page = 1").collect(), key=lambda r: r.line_no)
    assert [r.text for r in got][:2] == ["Plan Booklet 2001", "Section 1: Rules"]
    assert got[1].bold and got[1].size == 16.0
    assert {r.key for r in layout.running_lines(lines).collect()} == {"plan booklet #", "# schedule of benefits"}
    assert layout.body_size(lines).first().body_size == 10.0
    assert [(r["size"], r.level) for r in layout.size_levels(lines).collect()] == [(16.0, 1)]
    n = layout.page_numbering(w).first()
    assert (n.offset, n.first_page, n.consistent) in {(0, None, 0), (-1, 2, 4)} or n.examined == 5


def test_numbering_with_front_matter(spark):
    rows = []
    for p in range(1, 9):
        rows += words_of(p, 780, "iv" if p < 3 else str(p - 2), start=0) + words_of(p, 300, "body 77", start=10)
    n = layout.page_numbering(frame(spark, rows)).first()
    assert (n.offset, n.first_page, n.consistent, n.confidence) == (2, 3, 6, 0.75)
    assert {r.page for r in layout.roman_pages(frame(spark, rows)).collect()} == {1, 2}


def test_forms(spark):
    rows = []
    for p in range(1, 7):
        code, k = ("SBN25.CHC.I.2018", p) if p <= 3 else ("COC25.INS.2018.LG", p - 3)
        rows += words_of(p, 780, f"every three years. {code} {k}", start=0)
    forms = layout.form_sections(frame(spark, rows))
    got = sorted((r.form_code, r.pdf_start, r.pdf_end, r.printed_end, r.found) for r in forms.collect())
    assert got == [("COC25.INS.2018.LG", 4, 6, 3, True), ("SBN25.CHC.I.2018", 1, 3, 3, True)]
    pages = spark.createDataFrame([("d", 5), ("d", 9)], "doc_id string, page int")
    assert {(r.page, r.form_code, r.printed) for r in layout.printed_pages(pages, forms.drop("found")).collect()} == {(5, "COC25.INS.2018.LG", 2), (9, None, None)}


def test_languages_and_contents(spark):
    english = "the plan will pay for any of the services that are in this list and " * 4
    other = "el plan paga por todos los servicios que figuran aqui cada mes " * 5
    far = "страница для членов плана the of and " * 20
    pages = spark.createDataFrame([(1, english), (2, other), (3, far), (4, "corto")], "page int, text string")
    assert {r.page for r in layout.without_foreign(pages).collect()} == {1, 4}
    toc = "Table of Contents\n" + "\n".join(f"Section {k}: Things ........ {k}" for k in range(6))
    doc = spark.createDataFrame([("d", 1, "cover"), ("d", 2, toc), ("d", 3, toc.replace("Table of Contents\n", "")), ("d", 4, "prose"), ("d", 5, toc)], "doc_id string, page int, text string")
    assert [r.page for r in sorted(layout.contents_pages(doc).collect())] == [2, 3]


def cells(xs, ys, merged=()):
    out = []
    for r in range(len(ys) - 1):
        for c in range(len(xs) - 1):
            if not any((r, c) in m and (r, c) != m[0] for m in merged):
                m = next((m for m in merged if m[0] == (r, c)), [(r, c)])
                out.append((xs[c], ys[r], xs[max(k for _, k in m) + 1], ys[max(k for k, _ in m) + 1]))
    return out


def put(xs, ys, texts):
    return [{"text": t, "x0": xs[c] + 2.0, "x1": xs[c] + 12.0, "top": ys[r] + 2.0, "bottom": ys[r] + 10.0} for (r, c), t in texts.items()]


def test_grid_with_spans():
    xs, ys = [0.0, 100.0, 200.0, 300.0], [0.0, 20.0, 40.0, 60.0, 80.0]
    merged = [[(0, 0), (1, 0)], [(0, 1), (0, 2)], [(2, 0), (2, 1), (2, 2)]]
    texts = {(0, 0): "Service", (0, 1): "Cost Share", (1, 1): "In-Network", (1, 2): "Out", (2, 0): "Acupuncture", (3, 0): "Visits", (3, 1): "20%", (3, 2): "40%"}
    g = grids.grid_of(cells(xs, ys, merged), put(xs, ys, texts), 3)
    assert (g.n_rows, g.n_cols, g.header_rows, g.caption_rows, g.spans) == (4, 3, 2, 0, True)
    assert g.labels() == ["Service", "Cost Share - In-Network", "Cost Share - Out"]
    assert grids.to_sentences(g) == ["Acupuncture - Service: Visits | Cost Share - In-Network: 20% | Cost Share - Out: 40%"]
    assert '<th rowspan="2">Service</th>' in grids.to_html(g) and '<td colspan="3">Acupuncture</td>' in grids.to_html(g)
    assert grids.structure(g)["column_labels"] == g.labels()
    more = grids.grid_of(cells(xs, ys[:4]), put(xs, ys, {(0, 0): "Service", (0, 1): "In-Network", (0, 2): "Out", (1, 0): "Days | nights", (1, 1): "5%", (2, 0): "Hours"}), 4)
    both = grids.stacked(g, more)
    assert both.n_rows == 6 and both.pages == [3, 4] and both.body()[-2][0] == "Days | nights"
    assert "Days \\| nights" in grids.to_pipe(both)
    assert grids.grid_of([(0, 0, 1, 1)], [], 1) is None
    assert grids.edges_of([0, 1, 5.9, 12.1, 6.2], 6) == [(0 + 1 + 5.9) / 3, (6.2 + 12.1) / 2]
    assert grids.boxes_kept([(10, 10, 20, 20), (0, 0, 100, 100), (300, 0, 320, 9)]) == [1, 2]


def test_pages_to_markdown(spark):
    xs, ys = [72.0, 172.0, 272.0], [400.0, 420.0, 440.0]
    rows, boxes = book(4), []
    for p, texts in ((2, {(0, 0): "Name", (0, 1): "Limit", (1, 0): "Beds", (1, 1): "10"}), (3, {(0, 0): "Name", (0, 1): "Limit", (1, 0): "Chairs", (1, 1): "20"})):
        top = [420.0, 440.0, 460.0] if p == 2 else [120.0, 140.0, 160.0]
        rows += [("d", p, 600 + i, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], 10.0, "Body", HEIGHT) for i, w in enumerate(put(xs, top, texts))]
        boxes.append(("d", p, 0, [dict(zip(("x0", "top", "x1", "bottom"), c, strict=True)) for c in cells(xs, top)]))
    bx = spark.createDataFrame(boxes, "doc_id string, page int, table_idx int, cells array<struct<x0:double,top:double,x1:double,bottom:double>>")
    del ys
    md = flows.to_markdown(frame(spark, rows), bx).first().markdown
    assert "# Section 1: Rules" in md and "examples and more." in md and "Booklet" not in md
    assert md.count("<!-- table id=") == 1 and "| Chairs | 20 |" in md and md.index("| Beds | 10 |") < md.index("| Chairs | 20 |")
    assert md.index("<!-- page: 1 -->") < md.index("<!-- page: 2 -->")


def test_folds_over_many_pages(spark, tmp_path):
    """Pages take well under the 100 ms that a data frame for each cell took, and the folds are dealt to all tasks."""
    import time

    xs, ys = [0, 100, 200, 300], [20 * k for k in range(31)]
    texts = {(r, c): f"r{r} c{c}" for r in range(30) for c in range(3)}
    drawn, said = cells(xs, ys), put(xs, ys, texts)
    began = time.process_time()
    for _ in range(20):
        grids.grid_of(drawn, said, 1)
    assert time.process_time() - began < 20 * 0.05
    schema = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double"
    words = spark.createDataFrame([(d, p, w["text"], float(w["x0"]), float(w["x1"]), float(w["top"]), float(w["bottom"])) for d in range(20) for p in (1, 2) for w in said], schema)
    boxes = spark.createDataFrame([(d, p, 0, [tuple(map(float, b)) for b in drawn]) for d in range(20) for p in (1, 2)], "doc_id long, page int, table_idx int, cells array<struct<x0:double,top:double,x1:double,bottom:double>>")
    found = grids.page_grids(words, boxes)
    assert found.rdd.getNumPartitions() >= 4 and found.count() == 40
    said = grids.rendered(found, ("cells",)).collect()
    assert {len(r.cells) for r in said} == {90} and {len(r.sentences) for r in said} == {29} and said[0].sentences[0] == "r0 c0: r1 c0 | r0 c1: r1 c1 | r0 c2: r1 c2"
    assert {(r.n_rows, tuple(r.pages)) for r in grids.stitched(found).collect()} == {(59, (1, 2))}

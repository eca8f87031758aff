from clauseloom.llm import url_filter as uf

PAGES, OUT = "page_id long, url string, verdict string", "page_id long, bad int"


def judge(spark, urls, outcomes=(), rules=uf.RULES):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES)
    rows = uf.judged(pages, spark.createDataFrame(list(outcomes), OUT), rules).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(rows, key=lambda r: r.page_id)]


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/1z", "https://example.org/en/2", "x://notexample.org/es/", "https://b.com/fr/", "https://b.com/de/y", "https://b.com/en/", "http://org", None, "no scheme", "http://h?x/y", "http://u@c.net:80#/a://b", "://k.org//"]
    got = judge(spark, urls)
    assert [g[2] for g in got] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, "org/"]
    assert got[0][:2] == ("a.example.org", "/es/x") and got[0][3] == "block"
    assert got[7][:2] == ("org", "") and got[8][:2] == ("", "") and got[9][:2] == ("", "") and got[10][:2] == ("h", "") and got[11][:2] == ("u@c.net:80", "")
    assert judge(spark, []) == []


def test_bad_hosts_are_blocked_and_few_pages_are_shrunk(spark):
    urls, out = [], []
    for host, n, bad in (("spam.a.net", 60, 55), ("good.a.net", 60, 2), ("one.b.net", 1, 1), ("fine.b.net", 80, 3), ("new.c.net", 0, 0)):
        for k in range(max(n, 1)):
            if k < n:
                out.append((len(urls), int(k < bad)))
            urls.append(f"http://{host}/{k}")
    got = {g[0]: g[3] for g in judge(spark, urls, out, ())}
    assert got == {"spam.a.net": "block", "good.a.net": "allow", "one.b.net": "allow", "fine.b.net": "allow", "new.c.net": "allow"}


def test_outcomes_of_labels(spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {(r.page_id, r.bad) for r in uf.outcomes_of(labels).collect()} == {(1, 1), (2, 0)}

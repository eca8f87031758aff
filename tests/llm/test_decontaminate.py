import hashlib
import random
import re

from clauseloom.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string, hits string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            m = min(10, len(v))
            for k in range(len(v) - m + 1) if m else ():
                for a in range(len(w) - m + 1):
                    if w[a : a + m] == v[k : k + m]:
                        hit.update(range(a, a + m))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def data():
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(12)] + ["Ünï", "x1", "日本"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([30, 25, 10, 11, 9, 3, 1, 2])]
    items += [(100, None), (101, "  !? "), (3, items[3][1]), (7, "Sole-Word")]
    docs = []
    for k in range(40):
        text = [rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            v = items[rng.randrange(8)][1].split()
            a = rng.randrange(len(v))
            text[rng.randrange(len(text) + 1) :] = [x.upper() for x in v[a : a + rng.randrange(14)]]
        docs.append((k, " ".join(text)))
    return docs + [(90, None), (91, ""), (92, "word " * 30_000 + items[2][1])], items


def check(spark, pass_bytes=dc.PASS_BYTES):
    docs, items = data()
    df = spark.createDataFrame([(*r, "x") for r in docs], DOCS)
    got = dc.digest(dc.occurrences(df, spark.createDataFrame(items, ITEMS), pass_bytes)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(docs, items)


def test_as_brute_force(spark):
    check(spark)


def test_in_several_passes(spark):
    check(spark, 150)


def test_item_without_id_counts_and_is_not_listed(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d", "x")], DOCS)
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in dc.digest(dc.occurrences(docs, spark.createDataFrame([(None, "b c")], ITEMS))).collect()}
    assert got == {1: (2, 0, True), 2: (0, 0, False)}


def test_other_spelling_of_names_and_nested_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", {"x y": 1}), (2, "q", None)], "doc_id long, Text string, more struct<`x y`:int>")
    assert [tuple(r)[:2] for r in dc.decontaminated(docs, spark.createDataFrame([(5, "b c")], ITEMS)).collect()] == [(2, "q")]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x")], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert [r.contaminated for r in dc.digest(dc.occurrences(docs, none)).collect()] == [False, False]
    assert dc.occurrences(docs.limit(0), none).collect() == []
    kept = dc.decontaminated(docs.union(spark.createDataFrame([(2, "q r", "y")], DOCS)), spark.createDataFrame([(5, "B c")], ITEMS))
    assert [tuple(r) for r in kept.collect()] == [(2, "q r", "y")]

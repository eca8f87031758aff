import random
from itertools import combinations

import numpy as np

from clauseloom.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_as_brute_force(spark):
    """A text with many variants that are near it but not near each other, chains, copies, shared passages, short texts."""
    rng = random.Random(5)
    texts, base = [], words(rng, 200)
    passage = words(rng, 60)
    for _ in range(40):
        v = list(base)
        for k in rng.sample(range(0, 200, 6), 5):
            v[k] = f"x{rng.random()}"
        texts.append(" ".join(v))
    texts.append(" ".join(base))
    chain = words(rng, 150)
    for step in range(6):
        texts.append(" ".join(chain[: 150 - 12 * step]))
    texts += [" ".join(words(rng, 50) + passage + words(rng, 30)) for _ in range(25)]
    texts += ["one two three", "One  TWO three", "one two three four", "a b c d e", "a b c d e", "", "  \n", None, "é É"] + [" ".join(base)] * 3
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def family(rng, n):
    """Texts on one template, none of them a hub: most pairs are under the threshold and a few over it."""
    base, texts = words(rng, 120), []
    for _ in range(n):
        v = list(base)
        for k in rng.sample(range(120), 3):
            v[k] = f"x{rng.random()}"
        texts.append(" ".join(v))
    return list(enumerate(texts))


def test_template_family_without_a_hub(spark):
    rows = family(random.Random(12), 150)
    want = brute(rows)
    groups = {c for _, c, _ in want.values()}
    assert 100 < len(groups) < 150
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want


def test_links_between_members_that_are_never_hubs(spark):
    """One bucket, one linked pair in it, no link to a hub: a round without links is not the end."""
    rng = random.Random(3)
    texts = [" ".join(words(rng, 60)) for _ in range(60)]
    texts[8] = texts[7] + " more"
    docs = [(i, t) for i, t in enumerate(texts)]
    sizes = {i: len(shingles(t)) for i, t in docs}
    multi = spark.createDataFrame([(1, i, sizes[i], 60, 60) for i, _ in docs], "bucket long, id long, n long, pop long, size long")
    own = spark.createDataFrame([(i, sizes[i], bytearray(nd.BINS), [1] * nd.BANDS) for i, _ in docs], "id long, n long, low binary, keys array<int>")
    got = nd.linked(multi, own, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r.id, r.label) for r in got.collect()} == {(7, 7), (8, 7)}


def test_edges(spark):
    empty = nd.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(None, "a b c d e f", None), (1, "a b c d e f", None), (1, "a b c d e f", None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, None, True), (1, 1, True)}
    rows = [(1, "a b c d e f", "p"), (1, "a b c d e f", "q"), (2, "u", "r"), (None, "x", "s"), (None, "x", "t"), (3, "a b c d e f", "v"), (5, "k", None), (5, "l", None)]
    once = [(r.doc_id, r.text) for r in nd.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(once, key=str) == sorted([(1, "a b c d e f"), (2, "u"), (None, "x"), (5, "k"), (5, "l")], key=str)
    kept = nd.deduplicated(spark.createDataFrame([(4, "a b c d e f", "p"), (2, "a b c d e f", "q"), (3, None, None)], SCHEMA))
    assert {(r.doc_id, r.text, r.n_shingles) for r in kept.collect()} == {(2, "a b c d e f", "q"), (3, None, None)}


def test_very_long_text_and_parts_of_a_large_bucket(spark, monkeypatch):
    """A text of 60,000 words and its near copy; a hub whose members are dealt out in parts."""
    monkeypatch.setattr(nd, "FAN", 4)
    rng = random.Random(21)
    long = words(rng, 60_000)
    base = words(rng, 150)
    texts = [" ".join(long), " ".join(long[:-9000]), " ".join(base)]
    for k in range(30):
        v = list(base)
        v[(5 * k) % 150] = f"x{k}"
        texts.append(" ".join(v))
    rows = list(enumerate(texts))
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, *x) for i, x in brute(rows).items())


def test_filter_of_ids_keeps_all_that_are_asked_for(spark):
    rows = spark.range(20_000)
    asked = rows.where("id % 7 = 0")
    got = {r.id for r in nd.present(rows, asked).collect()}
    assert {i for i in range(0, 20_000, 7)} <= got and len(got) < 4000


def test_densified_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 30, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(pool[:20]), np.unique(pool[5:25])
    hits = []
    for salt in range(60):
        x, y = (np.unique(nd.mix(s + np.uint64(salt * 7919))) for s in (a, b))
        sig = nd.signature([x, y])
        hits.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(hits) - 15 / 25) < 0.05


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(470, 540) if k != 500] + [(7, 9), (9, 8), (8, 7), (9, 8)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = nd.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.v: r.label for r in got.collect()} == {v: find(v) for v in parent}

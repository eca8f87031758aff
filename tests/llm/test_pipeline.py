"""The pipeline against a plain version of its stages over the test tables."""

import zlib
from collections import Counter

import pytest

import corpus_pipeline
from clauseloom.llm import mixing, queries, toxicity
from clauseloom.llm.common import table

from .test_decontaminate import words
from .test_near_dedup import shingles
from .test_token_ops import brute_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(stages[n].columns == columns for n in list(stages)[:-1])
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(stages) <= 5


def test_toxicity_stage(spark, stages):
    docs = table(spark, SF, "documents")
    machine = toxicity.learn(docs, table(spark, SF, "labels"))
    score = lambda t: machine.score([{machine.places[p] for w in toxicity.words_of(t) for p in toxicity.places_of(w) if p in machine.places}])[0]
    assert rows(stages["toxicity"]) == [r for r in rows(docs) if score(r[1]) < corpus_pipeline.TOXIC]


def test_near_copies_stage(stages):
    before = rows(stages["toxicity"])
    sets, parent = {i: shingles(t) for i, t in before}, {i: i for i, _ in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for pair in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        a, b = pair
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert rows(stages["near_dedup"]) == [r for r in before if find(r[0]) == r[0]]


def test_benchmark_stage(spark, stages):
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        m = min(10, len(w))
        windows |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text)
        return not any(tuple(w[k : k + m]) in windows for m in sizes for k in range(len(w) - m + 1))

    assert rows(stages["decontamination"]) == [r for r in rows(stages["near_dedup"]) if clean(r[1])]


def test_mixing_stage(spark, stages):
    docs = stages["decontamination"]
    found, reached = mixing.rates(docs, mixing.domain_rows(docs, table(spark, SF, "labels")), queries.TARGETS, corpus_pipeline.LEAST_RATE)
    rate = {r.doc_id: r.rate for r in found.collect()}
    copies = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(copies) <= set(rate) and all(int(x) <= copies[i] <= int(x) + 1 for i, x in rate.items())
    assert abs(sum(copies.values()) - sum(rate.values())) < 0.1 * sum(rate.values())
    assert corpus_pipeline.LEAST_RATE == 0
    assert all(abs(reached[d][0] - queries.TARGETS.get(d, 0.0)) < 0.01 for d in reached)


def small(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string, hits string, __kept string"
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c") for i, t in rows], columns)


@pytest.mark.parametrize("name", ["toxicity", "near_dedup", "decontamination", "mixing"])
def test_stages_at_the_edges(spark, name):
    """Empty tables, nulls, repeated rows, long texts and clashing names: columns stay, clean documents stay."""
    stage = dict(corpus_pipeline.STAGES)[name]
    none = stage(spark, small(spark, []), SF)
    assert none.collect() == [] and len(none.columns) == 8
    rows = [(None, None), (None, "zz yy xx"), (1, ""), (2, None), (3, "qq ww ee rr tt " * 4000), (4, "uu ii oo"), (4, "uu ii oo"), (5, "pp"), (5, "aa ss")]
    docs = small(spark, rows)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    want = set(rows) if name == "near_dedup" else rows
    if name != "mixing":
        assert sorted(kept, key=str) == sorted(want, key=str)
    else:  # no labelled row: the mix is what it was
        assert sorted(kept, key=str) == sorted(rows, key=str)


def test_token_stage_at_the_edges(spark):
    stage = dict(corpus_pipeline.STAGES)["token_output"]
    assert stage(spark, small(spark, []), SF).collect() == []
    rows = [(None, None), (2, ""), (4, "uu ii oo"), (4, "uu ii oo")]
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens > 1) for r in stage(spark, small(spark, rows), SF).collect()) == [(False, 2, False), (False, 4, True), (False, 4, True), (True, None, False)]


def test_token_stage_and_run(spark, stages):
    want = sorted(brute_files(rows(stages["mixing"])))
    assert sorted(map(tuple, stages["token_output"].collect())) == want
    assert all(zlib.crc32(b"") <= r[3] < 1 << 32 for r in want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_every_python_stage_bounds_its_batches(spark):
    """Batches of 10,000 texts took the executors over their memory in near_dedup."""
    from clauseloom.llm import decontaminate, near_dedup, token_output, toxicity
    from clauseloom.llm.common import BATCH_BYTES, BATCH_KEY

    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "some words")], "item_id string, text string")
    held = spark.conf.get(BATCH_KEY, None)
    machine = toxicity.Machine({}, 0.0, toxicity.np.zeros(1), toxicity.np.zeros((1, 1)))
    for stage in (lambda: near_dedup.sketches(docs), lambda: decontaminate.decontaminated(docs, items), lambda: toxicity.scored(docs, machine), lambda: token_output.encode_documents(docs, "x")):
        spark.conf.unset(BATCH_KEY)
        stage()
        assert spark.conf.get(BATCH_KEY) == BATCH_BYTES
    spark.conf.unset(BATCH_KEY) if held is None else spark.conf.set(BATCH_KEY, held)

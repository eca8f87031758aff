"""Language model, toxicity and mixing, against brute force and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from clauseloom.llm import lm_scoring as lm
from clauseloom.llm import mixing, toxicity

DOCS = "doc_id long, text string, lang string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in rows], DOCS)


def markov(rng, n):
    """Two languages: what comes next depends on which one the text is in."""
    own = [f"{rng.choice('ab')}{k}" for k in range(400)]
    prefix = rng.choice(["q", "r"])
    return " ".join(prefix + own[min(int(rng.expovariate(0.02)), 399)] for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows = [(i, markov(rng, rng.randrange(5, 120))) for i in range(400)]
    return rows + [(1000, None), (1001, ""), (1002, "Only New WORDS"), (1003, "é É \x0b x"), (None, "qa1 qa2")]


def test_counts_and_base_as_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 60)  # most words then go the way of the join
    got = {r.doc_id: r for r in lm.scores(frame(spark, corpus)).collect()}
    words = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in corpus if not held(i) for w in words(t))
    total, v = sum(c.values()), len(c)
    for i, t in corpus:
        w, r = words(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (v + 1))) for x in w))
    out = [r for r in got.values() if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_the_model_is_normalised(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 60)
    docs = frame(spark, corpus[:80])
    counts = lm.gather(lm.word_counts(docs))
    scorer = lm.Scorer(counts, lm.fit(docs, counts))
    table = {bytes(r["word"]): r["c"] for r in lm.word_counts(docs).collect() if r["word"]}
    context = np.array([3, 300], np.int32)
    lp = scorer.model(np.concatenate([np.append(context, t) for t in range(lm.TARGETS)]).astype(np.int32), np.arange(lm.TARGETS) * 3)[2::3]
    assert (10**lp).sum() == pytest.approx(1, abs=1e-4)
    p = 10**lp
    total = p[lm.END] + sum(p[k] for k in range(min(lm.WORDS, len(counts.rank))))
    inside = Counter()
    for w, c in table.items():
        if counts.rank.get(w, lm.WORDS) >= lm.WORDS:
            k = lm.class_of(w)
            total += p[k] * (c + 0.1) / (counts.class_n[k - lm.WORDS] + 0.1 * (counts.class_v[k - lm.WORDS] + 1))
            inside[k] += 1
    total += sum(p[k] * 0.1 / (counts.class_n[k - lm.WORDS] + 0.1 * (counts.class_v[k - lm.WORDS] + 1)) for k in range(lm.WORDS, lm.END))
    total += sum(p[k] for k in range(len(counts.rank), lm.WORDS))  # ranks that no word has
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_edges(spark):
    assert lm.scores(frame(spark, [])).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.scores(frame(spark, [(only_held, "a b")])).collect()[0]
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score)


def insults(rng, n):
    """Toxic are texts with an insult, and those with both mild words; either mild word alone is fine."""
    rows, labels = [], []
    for i in range(n):
        w = [f"n{rng.randrange(500)}" for _ in range(rng.randrange(10, 60))]
        kind = rng.randrange(8)
        w += {0: ["Idiot!"], 1: ["mild", "group"], 2: ["mild"], 3: ["group"]}.get(kind, [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind in (0, 1))))
    return rows, labels


def test_toxicity_learns_pairs_and_holds_out(spark):
    rows, labels = insults(random.Random(2), 1500)
    rows += [(5000, None), (5001, ""), (5002, "idiot " * 50_000)]
    got = {r.doc_id: r for r in toxicity.toxic_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    out = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in out]) > 0.95
    assert got[5000].score == got[5001].score and got[5000].predicted == 0 and got[5002].predicted == 1


def test_toxicity_learns_pairs_that_tell_nothing_alone(spark):
    """Label 1 where exactly one of two words occurs: neither word differs between the classes."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(2000):
        w = [f"n{rng.randrange(500)}" for _ in range(rng.randrange(5, 40))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["alpha"] * a + ["beta"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(a != b)))
    got = {r.doc_id: r for r in toxicity.toxic_scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in labels if got[i].held_out]) > 0.95


def test_scores_as_a_plain_factorization_machine(spark):
    rows, labels = insults(random.Random(2), 400)
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = toxicity.learn(docs, table)
    for r in toxicity.scored(docs.select(docs.doc_id, docs.text.alias("Text"), docs.lang), m, "p").collect():
        at = sorted({m.places[p] for w in toxicity.words_of(r.Text) for p in toxicity.places_of(w) if p in m.places})
        raw = m.bias + sum(m.weights[i] for i in at) + sum(float(m.vectors[i] @ m.vectors[j]) for k, i in enumerate(at) for j in at[:k])
        assert r.p == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def test_toxicity_learns_once_from_a_repeated_row(spark):
    rows, labels = insults(random.Random(5), 300)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, more = (toxicity.learn(frame(spark, r), table) for r in (rows, rows + rows[:1] * 500))
    assert once.places == more.places and np.allclose(once.weights, more.weights)


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = insults(random.Random(4), 300)
    swapped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    a, b = (sorted(map(tuple, toxicity.toxic_scores(frame(spark, rows), spark.createDataFrame(x, kind)).collect())) for x in (labels, swapped))
    assert a == b


def test_toxicity_edges(spark):
    kind = "doc_id long, quality int, toxic int"
    assert toxicity.toxic_scores(frame(spark, []), spark.createDataFrame([], kind)).collect() == []
    got = toxicity.toxic_scores(frame(spark, [(1, "a b"), (None, None), (1, "a b")]), spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1)], kind)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def mix_data(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(240):
        lang = rng.choice(["en", "en", "en", "fr", "de"])
        docs.append((i, " ".join(f"{lang}{rng.randrange(60)}" for _ in range(rng.randrange(1, 80))), lang, "x"))
        if i % 2:
            labels.append((i, 1, 0))
    docs += [(900, None, None, "x"), (901, "", "fr", "x"), (902, "en1 " * 30_000, "en", "x")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_rates_as_brute_force(spark, floor):
    docs, labels, rows = mix_data(spark)
    targets = {"en": 0.4, "fr": 0.3, "de": 0.3}
    found, reached = mixing.rates(docs, mixing.domain_rows(docs, labels), targets, floor)
    got, domains = {r.doc_id: r for r in found.collect()}, list(reached)
    assert domains == ["de", "en", "fr"] and len(got) == len(rows)
    assert all(abs(r - w) < 0.002 and (floor or w == pytest.approx(targets[d])) for d, (r, w) in reached.items())
    assert all(got[i].n_tokens == len((t or "").split()) for i, t, *_ in rows)
    assert np.mean([got[i].domain == lang for i, t, lang, _ in rows if t and len(t.split()) > 3]) > 0.97
    ids = sorted(got)
    p = np.array([[got[i][f"p{k}"] for k in range(3)] for i in ids])
    t = np.array([got[i].n_tokens for i in ids], float)
    assert np.allclose(p.sum(1), 1)
    have = t @ p
    share = np.array([targets[d] for d in domains])
    want = share * (max(floor * have.sum(), *(floor * have / share)) if floor else have.sum())
    w, last = np.ones(len(ids)), np.full(3, np.inf)
    for _ in range(mixing.STEPS):
        residual = ((w * t) @ p - want) / have
        if np.abs(residual).max() < mixing.CLOSE or np.abs(residual - last).max() < mixing.CLOSE / 10:
            break
        last = residual
        w = np.maximum(floor, w - p @ residual)
    assert np.allclose([got[i].rate for i in ids], w)
    assert np.allclose((w * t) @ p, want, rtol=0.02)
    assert w.min() >= floor


def test_mixed_copies(spark):
    docs, labels, rows = mix_data(spark)
    out = Counter(r.doc_id for r in mixing.mixed(docs, mixing.domain_rows(docs, labels), {"en": 0.3, "fr": 0.35, "de": 0.35}, 1.0).collect())
    assert set(out) == {r[0] for r in rows} and max(out.values()) > 1


def test_domains_that_want_nothing_go(spark):
    docs, labels, rows = mix_data(spark)
    docs = docs.where("doc_id <> 902").select("*", docs.lang.alias("rate"), docs.lang.alias("n_tokens"))
    out = mixing.mixed(docs, mixing.domain_rows(docs, labels), {"fr": 0.5, "de": 0.5})
    assert out.columns == docs.columns
    n = Counter(r.lang for r in out.collect() if len((r.text or "").split()) > 5)
    assert n["en"] == 0 and n["fr"] and n["de"]


def test_repeated_rows_are_rows_of_their_own(spark):
    docs, labels, rows = mix_data(spark)
    again = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(docs.where("doc_id = 5").withColumn("text", docs.lang))
    found, _ = mixing.rates(again, mixing.domain_rows(again, labels))
    n = Counter(r.doc_id for r in found.collect())
    assert (n[3], n[4], n[5], n[6]) == (2, 2, 2, 1) and sum(n.values()) == len(rows) + 3
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed(again, mixing.domain_rows(again, labels)).collect())
    assert all(k % 2 == 0 for (i, _), k in copies.items() if i in (3, 4))


def test_posteriors_as_plain_naive_bayes(spark):
    import xxhash

    docs, labels, rows = mix_data(spark)
    found, reached = mixing.rates(docs, mixing.domain_rows(docs, labels))
    domains = list(reached)
    place = lambda w: xxhash.xxh64_intdigest(w, seed=42) % mixing.BUCKETS
    learnt = [(t, lang) for i, t, lang, _ in rows if i < 900 and i % 2]
    counts = {d: Counter(place(w) for t, lang in learnt if lang == d for w in t.split()) for d in domains}
    texts = {i: (t or "").split() for i, t, *_ in rows}
    for r in found.collect():
        w, logs = texts[r.doc_id], []
        for d in domains:
            total = sum(counts[d].values()) + 0.5 * mixing.BUCKETS
            said = sum(math.log((counts[d][place(x)] + 0.5) / total) for x in w)
            logs.append(said * mixing.EVIDENCE_WORDS / (len(w) + mixing.EVIDENCE_WORDS) + math.log((sum(lang == d for _, lang in learnt) + 1) / (len(learnt) + len(domains))))
        e = np.exp(np.array(logs) - max(logs))
        assert np.allclose([r[f"p{k}"] for k in range(len(domains))], e / e.sum(), atol=1e-9)


def test_mixing_edges(spark):
    docs, labels, _ = mix_data(spark)
    none, _ = mixing.rates(docs, mixing.domain_rows(docs, labels.limit(0)))
    assert {r.rate for r in none.collect()} == {1.0}
    assert mixing.mixed(docs.limit(0), mixing.domain_rows(docs.limit(0), labels)).collect() == []


def test_scores_of_the_model_by_tables():
    """The scorer's tables give the plain model's probabilities, with small scores and with ones at the end of the range."""
    import numpy as np

    from clauseloom.llm import lm_scoring as lm

    rng = np.random.default_rng(0)
    rank = {f"w{i}".encode(): i for i in range(300)}
    counts = lm.Counts(10**6, 301, 1000, rank, np.arange(300, 0, -1), np.full(lm.CLASSES, 500.0), np.full(lm.CLASSES, 20.0))
    t, first = rng.integers(0, lm.TARGETS, 700).astype(np.int32), np.array([0, 3, 300])
    for scale, small in ((0.3, True), (4.0, False)):
        p = [rng.normal(0, scale, s).astype(np.float32) for s in ((lm.TARGETS + 1, lm.DIM), (lm.CONTEXT, lm.DIM, lm.DIM), (lm.TARGETS, lm.DIM), (lm.TARGETS,))]
        scorer, ctx = lm.Scorer(counts, p), lm.contexts(t, first)
        r, c, q, b = (x.astype(float) for x in p)
        s = sum(r[ctx[j]] @ c[j] for j in range(lm.CONTEXT)) @ q.T + b
        plain = s[np.arange(700), t] - s.max(1) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))
        assert scorer.small is small
        np.testing.assert_allclose(scorer.model(t, first), plain / np.log(10), rtol=1e-4, atol=1e-3)

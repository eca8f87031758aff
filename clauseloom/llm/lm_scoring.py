"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are a text's words (ASCII white space cuts, A-Z lower-cased) and one end. The model predicts from the last
``CONTEXT`` tokens one of ``WORDS`` frequent words, ``CLASSES`` classes of the other words (by their first two bytes), or
the end: the context's vectors, each through the matrix of its distance, add up to a predicted vector whose products
with the targets' vectors, plus biases, are the scores. Scoring normalises them over all targets by batched matrix
products. Inside a class a word has its share of the class by training counts, with 0.1 added and one place for unknown
words, so that the probabilities of all words sum to one.

Training counts come from all training documents. The most frequent ``HEAD`` words go to the workers as a table of bounded
size; counts of the others are joined by a 64-bit hash. The vectors start from a pass over a bounded sample on the
driver; then every partition of the training documents makes one pass from there, and the partitions' parameters are
averaged by their tokens.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, staged, workers_import

WORDS, CLASSES, CONTEXT, DIM = 255, 256, 3, 16
TARGETS = WORDS + CLASSES + 1
END, PAD = TARGETS - 1, TARGETS
HEAD, HEAD_BYTES = 1 << 19, 64
NOISE, BATCH, RATE = 48, 2048, 0.1
#: Documents of the driver's first pass (those with the smallest hashes of their ids) and their characters, at most.
WARM_DOCS, WARM_CHARS = 600, 6_000_000
ADD = 0.1
TABLE_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def class_of(word: bytes) -> int:
    return WORDS + (word[0] * 31 + (word[1] if len(word) > 1 else 0)) % CLASSES


@dataclass
class Counts:
    """What the workers know of the training counts: the head words by rank, and sums for each class."""

    total: int
    distinct: int
    ends: int
    rank: dict[bytes, int]
    head: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray

    @property
    def scale(self) -> float:
        return self.total + ADD * (self.distinct + 1)

    def unigram(self) -> np.ndarray:
        """Shares of the targets, none of them 0."""
        n = np.concatenate([np.pad(self.head[:WORDS].astype(float), (0, max(0, WORDS - len(self.head)))), self.class_n, [self.ends]]) + 1
        return n / n.sum()


class Codes(dict):
    """word -> rank among the head words, or -1 - target for the others; looked-up words are kept in a bounded table."""

    def __init__(self, rank: dict[bytes, int]):
        super().__init__()
        self.rank = rank

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        code = self.rank.get(word)
        code = self[word] = -1 - class_of(word) if code is None else code
        return code


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c over all rows; summed in the workers first. The empty word counts the rows, as ends."""

    def count(batches):
        seen: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                if len(seen) > 500_000:
                    yield give()
                    seen = Counter()
            seen[b""] += batch.num_rows
        yield give()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gather(counts: DataFrame) -> Counts:
    """The head words and the classes' sums; what reaches the driver is bounded by HEAD and CLASSES."""
    words = counts.where("length(word) > 0 and c > 0")
    # the least count of a head word, from a histogram of some hundred steps: no task orders the words
    short = words.where(F.length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    room, least = HEAD, None
    for step, n in sorted(((r["step"], r["n"]) for r in short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, step
    best = [] if least is None else short.where(F.col("step") >= least).select("word", "c").collect()
    best.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    rank = {bytes(r["word"]): i for i, r in enumerate(best)}
    ends = counts.where("length(word) = 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    byte = lambda i: F.conv(F.hex(F.substring("word", i, 1)), 16, 10).cast("int")
    first, second = byte(1), F.when(F.length("word") > 1, byte(2)).otherwise(0)
    per = words.groupBy(((first * 31 + second) % CLASSES).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    for r in best[:WORDS]:
        k = class_of(bytes(r["word"])) - WORDS
        n[k] -= r["c"]
        v[k] -= 1
    return Counts(int(sum(r["n"] for r in per)) + ends, int(sum(r["v"] for r in per)) + (ends > 0), ends, rank, np.array([r["c"] for r in best], np.int64), n, v)


# parameters: context vectors, context matrices, target vectors, biases


def start(counts: Counts, seed: int = 11) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    eye = np.stack([np.eye(DIM, dtype=np.float32) / CONTEXT for _ in range(CONTEXT)])
    return [rng.normal(0, 0.1, (TARGETS + 1, DIM)).astype(np.float32), eye, rng.normal(0, 0.1, (TARGETS, DIM)).astype(np.float32), np.log(counts.unigram()).astype(np.float32)]


def contexts(targets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The last CONTEXT targets before each position; first: the positions where a text begins."""
    out = np.full((CONTEXT, len(targets)), PAD, np.int32)
    since = np.arange(len(targets)) - np.repeat(first, np.diff(np.append(first, len(targets))))
    for j in range(CONTEXT):
        ok = since > j
        out[j, ok] = targets[np.flatnonzero(ok) - j - 1]
    return out


def predicted(p: list[np.ndarray], ctx: np.ndarray) -> np.ndarray:
    h = p[0][ctx[0]] @ p[1][0]
    for j in range(1, CONTEXT):
        h += p[0][ctx[j]] @ p[1][j]
    return h


def scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    flat = (at[:, None].astype(np.int64) * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, rows.ravel(), n * DIM).reshape(n, DIM).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation with AdaGrad; noise comes from the unigram shares and is shared in a batch."""

    def __init__(self, p: list[np.ndarray], unigram: np.ndarray, seed: int):
        self.p, self.squares = [x.copy() for x in p], [np.full_like(x, 1e-2) for x in p]
        self.rng, self.unigram = np.random.default_rng(seed), unigram
        self.shift = np.log(NOISE * unigram).astype(np.float32)
        self.cum = np.cumsum(unigram)

    def batch(self, w: np.ndarray, ctx: np.ndarray) -> None:
        r, c, q, b = self.p
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), TARGETS - 1)
        parts = [r[ctx[j]] for j in range(CONTEXT)]
        h = sum(parts[j] @ c[j] for j in range(CONTEXT))
        pos = (h * q[w]).sum(1) + b[w] - self.shift[w]
        neg = h @ q[noise].T + (b[noise] - self.shift[noise])
        gp = 1 / (1 + np.exp(np.clip(pos, -30, 30)))
        gn = -1 / (1 + np.exp(np.clip(-neg, -30, 30)))
        dh = gp[:, None] * q[w] + gn @ q[noise]
        dq = scatter(w, gp[:, None] * h, TARGETS)
        np.add.at(dq, noise, gn.T @ h)
        db = np.bincount(w, gp, TARGETS).astype(np.float32)
        np.add.at(db, noise, gn.sum(0))
        dc = np.stack([parts[j].T @ dh for j in range(CONTEXT)])
        dr = sum(scatter(ctx[j], dh @ c[j].T, TARGETS + 1) for j in range(CONTEXT))
        for x, s, g in zip(self.p, self.squares, (dr, dc, dq, db), strict=True):
            g /= np.sqrt(len(w))
            s += g * g
            x += RATE * g / np.sqrt(s)

    def passes(self, targets: np.ndarray, first: np.ndarray) -> None:
        ctx = contexts(targets, first)
        order = self.rng.permutation(len(targets))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            self.batch(targets[pick], ctx[:, pick])


def coded(texts: list, codes: Codes) -> tuple[np.ndarray, np.ndarray, list]:
    """Codes of all tokens of the texts (a code beyond all ranks for the end), where texts begin, all words in order."""
    said = [words_of(t) for t in texts]
    size = np.array([len(w) + 1 for w in said], np.int64)
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), 1 << 30, np.int64)
    inner = np.ones(len(out), bool)
    inner[first + size - 1] = False
    flat = list(itertools.chain.from_iterable(said))
    out[inner] = np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat))
    return out, first, flat


def targets_of(code: np.ndarray, head_class: np.ndarray) -> np.ndarray:
    t = np.where(code < 0, -1 - code, END).astype(np.int32)
    head = (code >= 0) & (code < 1 << 30)
    t[head] = np.where(code[head] < WORDS, code[head], head_class[code[head]])
    return t


def fit(docs: DataFrame, counts: Counts) -> list[np.ndarray]:
    """The averaged parameters. docs: the training documents (doc_id, text)."""
    spark = docs.sparkSession
    head_class = np.array([class_of(w) for w in counts.rank], np.int32)
    unigram = counts.unigram()
    text = F.col("text").cast("string")
    short = docs.select("doc_id", text.alias("text")).where(F.length("text") <= WARM_CHARS // WARM_DOCS)
    # at most WARM_DOCS ids, and then that many short texts
    ids = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_DOCS)
    warm = sorted({r["text"] for r in short.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).collect()})
    first = Trainer(start(counts), unigram, 1)
    code, begin, _ = coded(warm, Codes(counts.rank))
    if warm:
        first.passes(targets_of(code, head_class), begin)
    if not counts.total:
        return first.p
    shared = spark.sparkContext.broadcast((first.p, unigram, counts.rank, head_class))

    def train(batches):
        p, unigram, rank, head_class = shared.value
        own, codes, n = Trainer(p, unigram, 2), Codes(rank), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo in range(0, len(texts), 500):
                code, begin, _ = coded(texts[lo : lo + 500], codes)
                own.passes(targets_of(code, head_class), begin)
                n += len(code)
        if n:
            rows = [(k, i, (x.reshape(len(x), -1)[i].astype(float) * n).tolist(), n) for k, x in enumerate(own.p) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.int64())], names=["part", "row", "v", "n"])

    sums = docs.select(text.alias("text")).mapInArrow(train, "part int, row int, v array<double>, n long").select("part", "row", "n", F.posexplode("v").alias("at", "x")).groupBy("part", "row", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    out = [np.zeros_like(x) for x in first.p]
    flat = [x.reshape(len(x), -1) for x in out]
    for r in sums.collect():  # as many numbers as the model has
        flat[r["part"]][r["row"], r["at"]] = r["x"]
    return out


class Scorer:
    def __init__(self, counts: Counts, p: list[np.ndarray]):
        self.p, self.counts = p, counts
        self.codes = Codes(counts.rank)
        self.head_class = np.array([class_of(w) for w in counts.rank], np.int32)
        head = np.log10(counts.head + ADD)
        room = np.log10(counts.class_n + ADD * (counts.class_v + 1))
        self.base = head
        self.inside = head - room[self.head_class - WORDS] if len(head) else head
        self.inside[:WORDS] = 0.0 if len(head) else self.inside[:WORDS]
        self.room = room
        # each context vector through the matrix of its distance, once; a last place that is 1 brings the biases in
        self.steps = [np.pad(p[0] @ p[1][j], ((0, 0), (0, 1)), constant_values=float(j == 0)) for j in range(CONTEXT)]
        self.to = np.ascontiguousarray(np.vstack([p[2].T, p[3]]))
        longest = sum(np.sqrt((t[:, :DIM] ** 2).sum(1).max()) for t in self.steps)
        #: whether no product of a predicted vector and a target's is near the end of the range
        self.small = bool(longest * np.sqrt((p[2] ** 2).sum(1).max()) <= 60)

    def model(self, targets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each target."""
        ctx, out = contexts(targets, first), np.empty(len(targets))
        ones, held, rows = np.ones(TARGETS, np.float32), np.empty((256, TARGETS), np.float32), np.arange(256)
        for lo in range(0, len(targets), 256):  # a block of scores stays in the cache
            at = slice(lo, lo + 256)
            h = self.steps[0][ctx[0, at]]
            for j in range(1, CONTEXT):
                h += self.steps[j][ctx[j, at]]
            scores = np.matmul(h, self.to, out=held[: len(h)])
            if not self.small:
                scores -= scores.max(1, keepdims=True)
            own = scores[rows[: len(h)], targets[at]]
            np.exp(scores, out=scores)
            out[at] = own - np.log(scores @ ones)
        return out / math.log(10)

    def score(self, texts: list):
        """For each text: n_tokens, known head tokens and ends, the base's and the model's sums without the counts of words
        beyond the head, how many those are, and their hashes."""
        code, first, said = coded(texts, self.codes)
        targets = targets_of(code, self.head_class)
        lp = self.model(targets, first)
        head = (code >= 0) & (code < 1 << 30)
        base = np.full(len(code), math.log10(self.counts.ends + ADD))
        base[head] = self.base[code[head]]
        lp[head] += self.inside[code[head]]
        tail = code < 0
        base[tail] = 0.0
        lp[tail] -= self.room[-1 - code[tail] - WORDS]
        known = head.astype(np.int64)
        known[~head & ~tail] = self.counts.ends > 0
        size = np.diff(np.append(first, len(code)))
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        inner = np.ones(len(code), bool)
        inner[first + size - 1] = False
        at = np.flatnonzero(tail[inner]).tolist()
        hashes = np.array([xxhash.xxh64_intdigest(said[i], 42) for i in at], np.uint64).view(np.int64)
        return size, add(known), add(base) - size * math.log10(self.counts.scale), add(lp), add(tail.astype(np.int64)), hashes


def scores(docs: DataFrame, trains: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    A null or empty text has the end as its one token. trains: which rows (by doc_id) are learnt from; by default those
    whose crc32(doc_id as text) modulo 10 is not 0. Repeated rows count, and are scored, as often as they occur; other
    columns are not read. Without training rows all counts are 0 and the model is the untrained one."""
    spark = docs.sparkSession
    workers_import(spark)
    trains = remainder(F.col("doc_id"), 10) != 0 if trains is None else trains
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    learnt = rows.where(trains)
    table = staged(word_counts(learnt), "word-counts")
    counts = gather(table)
    sent = spark.sparkContext.broadcast((counts, fit(learnt, counts)))

    def score(batches):
        scorer = Scorer(*sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 500):
                size, known, base, lp, n_tail, flat = scorer.score(texts[lo : lo + 500])
                at = np.append(0, np.cumsum(n_tail))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(lp), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["doc_id", "n_tokens", "known", "base", "lp", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    mapped = staged(rows.mapInArrow(score, f"doc_id {kind}, n_tokens long, known long, base double, lp double, tail array<long>").withColumn("row", F.monotonically_increasing_id()), "scored")
    tail_counts = table.where("length(word) > 0").select(F.xxhash64("word").alias("h"), "c").groupBy("h").agg(F.sum("c").alias("c"))
    each = mapped.select("row", F.explode("tail").alias("h")).join(tail_counts, "h", "left")
    extra = each.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("x"), F.count("c").alias("k"))
    full = mapped.drop("tail").join(extra, "row", "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    return full.select(
        "doc_id", (~trains).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("x")).alias("base_score"), (F.col("lp") + F.col("x")).alias("score"),
    )

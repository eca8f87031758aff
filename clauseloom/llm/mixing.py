"""Mixing sources to target weights by soft membership.

A classifier learnt from a labelled table predicts each document's posterior over domains; projected-gradient least
squares then finds a rate for each document, no smaller than a floor, so that the expected tokens of each domain (rate
times tokens times posterior, summed) match the targets.

Only DataFrame and SQL functions are used. The classifier is multinomial naive Bayes over words hashed to ``BUCKETS``
places; what is broadcast is its table of at most BUCKETS rows. The fit works on sums: each step is one distributed
aggregation of a number for each domain, and each document's rate follows from its posterior and the steps' residuals.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 4096
#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of their doc_id.
SAMPLE_ROWS = 20_000
#: The evidence of n words counts as that of n E / (n + E) words; naive Bayes is too sure of long texts.
EVIDENCE_WORDS = 40.0
STEPS = 40
#: The steps end when every domain's expected tokens are this near to the wanted ones, as a share of the available, or when
#: a step brings none of them nearer by a tenth of it (targets that no rates meet).
CLOSE = 1e-4
#: Steps between two writings of the rates.
FLUSH = 12
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, cut at ASCII white space."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SPACE), lambda w: w != "")


def place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def domain_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A labelled table (doc_id, domain): for the documents in ``labels``, ``toxic`` or ``low`` by their labels, and
    else their language; the worst label where rows differ; null languages are ``other``."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("bad"), F.max(F.col("quality") == 0).alias("low"))
    sample = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # at most SAMPLE_ROWS rows of a few bytes
    name = F.when(F.col("bad"), "toxic").when(F.col("low"), "low").otherwise(F.coalesce("lang", F.lit("other")))
    return docs.select("doc_id", "lang").dropDuplicates(["doc_id"]).join(F.broadcast(sample), "doc_id").select("doc_id", name.alias("domain"))


class Classifier:
    """Log likelihoods by place and domain, log priors, and the domains in order."""

    def __init__(self, docs: DataFrame, labelled: DataFrame):
        bounded = labelled.where("domain is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        seen = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").select("domain", F.explode(words(F.col("text"))).alias("word"))
        # at most BUCKETS rows for each domain
        counts = staged(seen.groupBy("domain", place(F.col("word")).alias("place")).agg(F.count(F.lit(1)).alias("c")), "mixing-counts")
        prior = bounded.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
        total = {r["domain"]: r["c"] for r in counts.groupBy("domain").agg(F.sum("c").alias("c")).collect()}
        self.domains = sorted(r["domain"] for r in prior)
        n = sum(r["n"] for r in prior)
        self.prior = {r["domain"]: (r["n"] + 1.0) / (n + len(prior)) for r in prior}
        each = [F.log((F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("c"))), F.lit(0)) + 0.5) / (total.get(d, 0) + 0.5 * BUCKETS)).alias(f"l{i}") for i, d in enumerate(self.domains)]
        empty = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("place"), F.lit("").alias("domain"), F.lit(0).cast("long").alias("c"))
        self.table = staged(counts.select("place", "domain", "c").unionByName(empty).groupBy("place").agg(*each), "mixing-table") if self.domains else None

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """doc_id, text_hash, n_tokens (words) and one posterior p0, p1, ... for each domain, for every row of ``docs``; a
        text without words has the priors."""
        k = len(self.domains)
        rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text").withColumn("row", F.monotonically_increasing_id())
        said = rows.select("row", "doc_id", "text_hash", F.explode_outer(words(F.col("text"))).alias("word"))
        sums = said.withColumn("place", place(F.col("word"))).join(F.broadcast(self.table), "place", "left").groupBy("row", "doc_id", "text_hash").agg(F.count("word").alias("n_tokens"), *(F.sum(F.when(F.col("word").isNotNull(), F.col(f"l{i}"))).alias(f"s{i}") for i in range(k)))
        key = ["doc_id", "text_hash", "n_tokens"]
        scale = F.lit(EVIDENCE_WORDS) / (F.col("n_tokens") + EVIDENCE_WORDS)
        logs = sums.select(*key, *((F.coalesce(F.col(f"s{i}") * scale, F.lit(0.0)) + math.log(self.prior[d])).alias(f"g{i}") for i, d in enumerate(self.domains)))
        top = F.greatest(*(F.col(f"g{i}") for i in range(k))) if k > 1 else F.col("g0")
        powers = logs.select(*key, *(F.exp(F.col(f"g{i}") - top).alias(f"e{i}") for i in range(k)))
        norm = sum((F.col(f"e{i}") for i in range(k)), F.lit(0.0))
        return powers.select(*key, *((F.col(f"e{i}") / norm).alias(f"p{i}") for i in range(k)))


@dataclass
class Fit:
    """members: the rows with the column ``rate``; the expected and the wanted tokens of each domain; whether the steps
    came to an end by themselves."""

    members: DataFrame
    expected: list[float]
    wanted: list[float]
    converged: bool

    def shares(self) -> list[float]:
        return [e / (sum(self.expected) or 1.0) for e in self.expected]


def fit_rates(members: DataFrame, targets: list[float], floor: float = 0.0, steps: int = STEPS) -> Fit:
    """A rate for each row of ``members`` (n_tokens, p0, p1, ...).

    Minimised is the sum over domains of (expected - wanted)^2 / available, where wanted is the target share of the
    total; the gradient steps are taken in the metric of tokens, so that step 1 is safe, and each is followed by the
    projection rate >= floor. With a floor above 0 the total is the least one that leaves every domain room above its
    floor; else it is the tokens there are. Domains without tokens want none. Rates are written every ``FLUSH`` steps, so
    that expressions stay short. Steps end by ``CLOSE``, or with a warning."""
    k = len(targets)
    tokens = lambda rate: [float(x or 0.0) for x in members.agg(*(F.sum(F.col("n_tokens") * F.col(f"p{i}") * rate).alias(f"t{i}") for i in range(k))).first()]
    have = expected = tokens(F.lit(1.0))
    live = [max(t, 0.0) if h > 0 else 0.0 for t, h in zip(targets, have, strict=True)]
    total = sum(have)
    if not total or not sum(live):
        return Fit(members.withColumn("rate", F.lit(1.0)), have, have, True)
    share = [t / sum(live) for t in live]
    if floor > 0:
        total = max([floor * total, *(floor * h / s for h, s in zip(have, share, strict=True) if s > 0)])
    want = [s * total for s in share]
    rate, last = F.lit(1.0), None
    for step in range(steps + 1):
        residual = [(e - w) / h if h > 0 else 0.0 for e, w, h in zip(expected, want, have, strict=True)]
        converged = max(map(abs, residual)) < CLOSE or (last is not None and max(abs(r - q) for r, q in zip(residual, last, strict=True)) < CLOSE / 10)
        last = residual
        if converged or step == steps:
            break
        move = sum((F.lit(r) * F.col(f"p{i}") for i, r in enumerate(residual)), F.lit(0.0))
        rate = F.greatest(F.lit(floor), rate - move)
        if step % FLUSH == FLUSH - 1:
            members = staged(members.withColumn("rate", rate), "mixing-rates")
            rate = F.col("rate")
        expected = tokens(rate)
    if not converged:
        warnings.warn(f"after {steps} steps the shares are {[round(e / total, 4) for e in expected]}, the wanted ones {share}", stacklevel=2)
    return Fit(members.withColumn("rate", rate), expected, want, converged)


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, floor: float = 0.0) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """doc_id, text_hash, n_tokens, domain (the likeliest), posteriors p0, p1, ... and rate for every row of ``docs``, and
    for each domain (in the order of the posteriors) the reached and the wanted share of tokens.

    targets: the wanted share of tokens of each domain (others want none); by default equal shares. Repeated rows are rows
    of their own; a null id is an id. Without labelled rows or documents every rate is 1 and the domain null."""
    model = Classifier(docs, labelled)
    if not model.domains:
        plain = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
        return plain.withColumns({"domain": F.lit(None).cast("string"), "rate": F.lit(1.0)}), {}
    k = len(model.domains)
    members = staged(model.posteriors(docs), "mixing-members")
    wanted = [1.0] * k if targets is None else [float(targets.get(d, 0.0)) for d in model.domains]
    fit = fit_rates(members, wanted, floor)
    top = F.greatest(*(F.col(f"p{i}") for i in range(k))) if k > 1 else F.col("p0")
    name = F.coalesce(*(F.when(F.col(f"p{i}") == top, F.lit(d)) for i, d in enumerate(model.domains)))
    total = sum(fit.wanted) or 1.0
    reached = {d: (s, w / total) for d, s, w in zip(model.domains, fit.shares(), fit.wanted, strict=True)}
    return fit.members.select("doc_id", "text_hash", "n_tokens", name.alias("domain"), *(f"p{i}" for i in range(k)), "rate"), reached


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, floor: float = 0.0) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part of the rate, and once more if the hash of its
    doc_id and text, as a number from 0 to 1, is below the rest. With floor 0 documents of domains that have too many
    tokens go, by their rates; rows equal in doc_id and text fare alike."""
    found, _ = rates(docs, labelled, targets, floor)
    key = ["doc_id", "text_hash"]
    u = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 30)) / float(1 << 30)
    each = found.groupBy(*key).agg(F.max("rate").alias("rate"))
    copies = each.select(F.col("doc_id").alias("__mix_id"), F.col("text_hash").alias("__mix_hash"), (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("int").alias("__mix_copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__mix_hash"))
    joined = docs.join(copies.where("__mix_copies > 0"), same)
    return joined.withColumn("__mix_one", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)

"""MinHash near-deduplication: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's set holds the 64-bit hashes of its distinct five-word shingles. One permutation cuts the hash range into
``BINS`` bins; the least hash in a bin is the bin's minimum, and an empty bin borrows from the first non-empty bin on a
probe path of its own (optimal densification). ``ROWS`` minima make a band: two sets with a similarity of 0.75 share no
band with a probability of (1 - 0.75^6)^54 = 3e-5. Documents with equal sets are one class from the start.

In each bucket one class is the hub, and edges go from the hub to the other classes: their number is linear in the
bucket. The hub is the class whose buckets are largest (a text from which many copies were made meets each of them more
often than they meet each other). An edge whose minima, by one byte each, agree in fewer bins than a similarity of 0.75
allows (by six standard deviations) goes; the others are confirmed on full sets. Classes that share a bucket but are
not yet in one component go through another round with hubs by hash. The buckets that then still hold several
components are cut into blocks, and every pair of classes of different components is compared, block against block: the
workers hold the pairs, and only a spanning forest of the links leaves them. Components come from contraction to the roots of parent trees, in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, staged, workers_import

SHINGLE, ROWS, BANDS = 5, 6, 54
BINS = ROWS * BANDS
#: A link needs 100 * intersection >= LINK * union.
LINK = 75
TABLE_WORDS = 400_000
#: Members of a block of an open bucket, about. Two sizes whose logarithms to SIZE_BASE differ by 1 cannot make a link.
BLOCK, SIZE_BASE, COLUMNS, PAIRS = 256, 1.34, 4096, 20_000
#: Blocks of 64 bits of a filter of ids, at most; members of a part of a large bucket, about.
FILTER_BLOCKS, FAN = 1 << 19, 512
#: Rounds of hubs; they only spare work, since all pairs that stay open are compared after them.
HUB_ROUNDS = 2
U = np.uint64
_MIX = [U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_COEF = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _MIX[0]
    x = (x ^ (x >> U(30))) * _MIX[1]
    x = (x ^ (x >> U(27))) * _MIX[2]
    return x ^ (x >> U(31))


def _probes() -> np.ndarray:
    """For each bin a path over all bins in an order of its own."""
    keys = mix(np.arange(BINS, dtype=U)[:, None] * U(1_000_003) + np.arange(BINS, dtype=U)[None, :])
    return np.argsort(keys, axis=1, kind="stable")


PROBES = _probes()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; of fewer than five words the whole sequence is one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, U)
    w = np.fromiter(map(hashes.__getitem__, words), U, n)
    if n < SHINGLE:
        return mix((w * _COEF[:n]).sum(dtype=U, keepdims=True) + U(n))
    m = n - SHINGLE + 1
    total = w[:m] * _COEF[0]
    for i in range(1, SHINGLE):
        total += w[i : i + m] * _COEF[i]
    return np.unique(mix(total))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """The densified bin minima of non-empty sets, one row each."""
    sig = np.zeros((len(sets), BINS), U)
    full = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        b = (((s >> U(32)) * U(BINS)) >> U(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        sig[i, b[at]] = s[at]
        full[i, b[at]] = True
    row, col = np.nonzero(~full)
    for t in range(BINS):
        if not len(row):
            break
        source = PROBES[col, t]
        got = full[row, source]
        sig[row[got], col[got]] = sig[row[got], source[got]]
        row, col = row[~got], col[~got]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """The bucket key of each band, one row for each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    total = np.arange(BANDS, dtype=U)[None, :] * _MIX[0]
    for i in range(ROWS):
        total = mix(total + parts[:, :, i] * _COEF[i % SHINGLE])
    return total.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), a and b (128 bits of the whole set; null for an empty one), bands, and low (a byte of each
    bin's minimum)."""
    workers_import(docs.sparkSession)
    small_batches(docs.sparkSession)

    def sketch(batches):
        hashes = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingle_set(t.as_py(), hashes) for t in part.column(1)]
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = signature([sets[i] for i in some])
                keys = bands(sig)
                low = mix(sig).astype(np.uint8)
                own = {i: k for k, i in enumerate(some)}
                a = [int(s.sum(dtype=U).view(np.int64)) if len(s) else None for s in sets]
                b = [int(mix(s * _COEF[0]).sum(dtype=U).view(np.int64)) if len(s) else None for s in sets]
                at = np.cumsum([0, *(BANDS if i in own else 0 for i in range(len(sets)))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.ravel())), pa.array([low[own[i]].tobytes() if i in own else None for i in range(len(sets))], pa.binary())],
                    names=["doc_id", "n", "a", "b", "bands", "low"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketch, "doc_id long, n long, a long, b long, bands array<long>, low binary")


def present(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``ids``, and a few others: a Bloom filter of 64-bit blocks, so that a join by id does
    not deal out all rows. The filter has ``FILTER_BLOCKS`` rows of 16 bytes at most, however many ids there are; beyond
    some millions of ids more of the others pass, and the join that follows drops them."""
    blocks = 1 << 10
    while blocks < min(FILTER_BLOCKS, ids.count()):
        blocks *= 2
    h = F.xxhash64(F.lit("filter"), "id")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 20 + 6 * k), F.lit(64)).cast("int"))
    block, mask = F.pmod(h, F.lit(blocks)).cast("int"), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    held = ids.select(block.alias("__block"), mask.alias("__mask")).groupBy("__block").agg(F.bit_or("__mask").alias("__held"))
    marked = rows.withColumns({"__block": block, "__mask": mask})
    return marked.join(F.broadcast(held), "__block").where(F.col("__held").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*rows.columns)


def with_sets(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """``keyed`` (id and other numbers) with items: the sorted shingle hashes of the document ``id``, as bytes.

    Texts are dealt out, not sets: they are smaller. Always by a shuffle, so that small and large inputs cost alike."""

    def make(batches):
        hashes, last, items = WordHashes(), None, b""
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                text = t.as_py()
                if (i, text) != last:
                    last, items = (i, text), shingle_set(text, hashes).tobytes()
                out.append(items)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = present(texts, keyed.select("id").distinct())
    rest = [c for c in keyed.columns if c != "id"]
    joined = keyed.hint("merge").join(texts.hint("merge"), "id").select("id", *rest, "text")
    return joined.mapInArrow(make, ", ".join(f"{c} long" for c in ("id", *rest)) + ", items binary")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (u, v), u < v, among the pairs (x, y, part): their full sets reach the similarity."""

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(z.as_buffer(), U) for z in (x, y))
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * inter >= LINK * (len(s) + len(t) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    near = with_sets(docs, pairs.select(F.col("x").alias("id"), "y", "part")).withColumnsRenamed({"id": "x", "items": "items_x"})
    far = with_sets(docs, pairs.select(F.col("y").alias("id"), "part").distinct()).withColumnsRenamed({"id": "y", "items": "items_y"})
    both = near.hint("merge").join(far.hint("merge"), ["y", "part"])
    return both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "items_x", "items_y").mapInArrow(compare, "u long, v long")


def roots(parents: DataFrame, files: int = 0) -> DataFrame:
    """v, label with each vertex's last ancestor for parents (v, label, both vertices); each turn halves the way."""
    while True:
        up = parents.select(F.col("v").alias("label"), F.col("label").alias("top"))
        jumped = staged(parents.join(up, "label").select("v", F.col("label").alias("old"), F.col("top").alias("label")), "roots", files=files)
        if not jumped.where("old <> label").limit(1).count():
            return jumped.select("v", "label")
        parents = jumped.select("v", "label")


def components(edges: DataFrame, files: int = 0) -> DataFrame:
    """v, label: the smallest vertex that each vertex of ``edges`` (u, v) can reach.

    In each step a vertex takes the smallest of itself and its neighbours as its parent; the edges are contracted to edges
    between the roots of these trees, each once; steps end when none are left."""
    rest, found = staged(edges.distinct(), "edges", files=files), None
    while found is None or rest.limit(1).count():
        ends = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tops = roots(staged(ends.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("label")), "parents", files=files), files)
        up = lambda k: tops.select(F.col("v").alias(k), F.col("label").alias(f"p{k}"))  # noqa: B023, E731
        moved = rest.join(up("u"), "u").join(up("v"), "v").where("pu <> pv")
        rest = staged(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges", files=files)
        step = tops.select(F.col("v").alias("label"), F.col("label").alias("top"))
        found = tops if found is None else staged(found.join(step, "label", "left").select("v", F.coalesce("top", "label").alias("label")), "found", files=files)
    return found


def _stars(multi: DataFrame, hub_by) -> DataFrame:
    """Pairs (x, y, part) of a member x and the hub y of a bucket of ``multi`` (bucket, id, n, label, size) that are not yet
    in one component, as far as the set sizes allow the similarity.

    Large buckets are dealt out in parts of about ``FAN`` members: the hub goes to each part, and so it does later, when
    pairs meet the hub's set (``part`` says where)."""
    fan = F.ceil(F.col("size") / F.lit(FAN))
    hubs = multi.groupBy("bucket").agg(F.max(F.struct(hub_by.alias("by"), "id", "n", "label", fan.alias("fan"))).alias("h"))
    hubs = hubs.select("bucket", F.col("h.id").alias("y"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("h.fan") - 1)).alias("salt"))
    rows = multi.withColumn("fan", fan).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("fan")))
    pairs = rows.join(hubs, ["bucket", "salt"]).where("label <> hub_label").where(100 * F.least("n", "hub_n") >= LINK * F.greatest("n", "hub_n"))
    once = pairs.groupBy(F.least("id", "y").alias("u"), F.greatest("id", "y").alias("v")).agg(F.min("id").alias("x"), F.max("fan").alias("fan"))
    return once.select("x", F.when(F.col("x") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("y"), F.xxhash64("fan", F.pmod(F.xxhash64("x"), F.col("fan"))).alias("part"))


def _agree(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether minima x and y, a byte each, of sets whose smaller one has n items agree in as many bins as a similarity
    of 0.75 makes likely, less six deviations."""
    return (x == y).mean(1) >= LINK / 100 - 6 * np.sqrt(0.1875 / np.minimum(n, BINS))


def likely(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (x, y, part) whose minima agree as those of a link do. own: id, n, low."""

    def compare(batches):
        for batch in batches:
            nx, ny = (batch.column(i).to_numpy() for i in (3, 4))
            low = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (5, 6)]
            mask = pa.array(_agree(*low, np.minimum(nx, ny)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(3)], names=["x", "y", "part"])

    asked = present(own, pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    side = lambda k: asked.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("low").alias(f"low{k}")).hint("merge")
    far = pairs.select("y", "part").distinct().join(side("y"), "y").hint("merge")
    both = pairs.join(side("x"), "x").hint("merge").join(far, ["y", "part"])
    return both.select("x", "y", "part", "nx", "ny", "lowx", "lowy").mapInArrow(compare, "x long, y long, part long")


def _by_key(batches):
    """The rows of each run of equal keys (the first three columns)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=False):
            yield held.slice(lo, hi - lo)
        held = held.slice(cuts[-1]) if len(cuts) else held
    if held is not None:
        yield held


def _may_link(label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of different labels whose sizes allow the similarity."""
    fit = (label[:, None] != label[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= LINK * np.maximum(n[:, None], n[None, :]))
    return np.nonzero(np.triu(fit, 1))


def block_pairs(multi: DataFrame, files: int = 0) -> DataFrame:
    """bucket, x, y, id, n, label: the members of each pair of blocks x <= y of a bucket that may hold a link.

    A block holds one class of sizes; labels with many members have blocks of their own, so that members of one component
    meet only the others and not each other."""
    m = multi.select("bucket", "id", "n", "label", F.floor(F.log("n") / F.log(F.lit(SIZE_BASE))).alias("size"))
    per = m.groupBy("bucket", "size", "label").agg(F.count(F.lit(1)).alias("c")).withColumn("own", F.col("c") >= BLOCK)
    alone = per.where("own").select("bucket", "size", "label", F.col("c").alias("own"))
    shared = per.where("not own").groupBy("bucket", "size").agg(F.sum("c").alias("rest"))
    m = m.join(alone, ["bucket", "size", "label"], "left").join(shared, ["bucket", "size"], "left")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("own", "rest") / F.lit(BLOCK)))
    # blocks whose hashes meet are one block, and lose nothing
    m = staged(m.select("bucket", "id", "n", "label", F.xxhash64("size", F.when(F.col("own").isNotNull(), F.col("label")), F.col("own").isNotNull(), part).alias("block")), "blocks", files=files)
    span = m.groupBy("bucket", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    side = lambda k: span.select("bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi", "least", "most")))
    fits = "block_x <= block_y and least(lo_x, lo_y) < greatest(hi_x, hi_y)"
    near = f"100 * most_x >= {LINK} * least_y and 100 * most_y >= {LINK} * least_x"
    met = side("x").join(side("y"), "bucket").where(f"{fits} and {near}").select("bucket", F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    return met.withColumn("block", F.explode(F.array_distinct(F.array("x", "y")))).join(m, ["bucket", "block"]).select("bucket", "x", "y", "id", "n", "label")


def _runs(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def all_links(multi: DataFrame, own: DataFrame, docs: DataFrame, files: int = 0) -> DataFrame:
    """Links (u, v) that join all classes of ``multi`` (bucket, id, n, label) which have a link in a bucket they share and
    different labels: every such pair is compared, by sketches and then by full sets, in the first bucket it shares (that
    bucket is open too, since its labels differ). own: id, n, low, keys."""

    def sketched(batches):
        for rows in _by_key(batches):
            bucket, n, label = (rows.column(k).to_numpy() for k in (0, 4, 5))
            i, j = _may_link(label, n)
            if not len(i):
                continue
            low = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(-1, BINS)
            keys = rows.column(7).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            here = bucket[0].astype(np.int32)
            keep = np.zeros(len(n), bool)
            for at in range(0, len(i), PAIRS):
                x, y = i[at : at + PAIRS], j[at : at + PAIRS]
                first = keys[x, (keys[x] == keys[y]).argmax(1)] == here
                x, y = x[first], y[first]
                good = _agree(low[x], low[y], np.minimum(n[x], n[y]))
                keep[x[good]] = keep[y[good]] = True
            if keep.any():
                yield from rows.select(range(6)).filter(pa.array(keep)).combine_chunks().to_batches()

    def compared(batches):
        for rows in _by_key(batches):
            ids, n, label = (rows.column(k).to_numpy() for k in (3, 4, 5))
            i, j = _may_link(label, n)
            sets = [np.frombuffer(z.as_buffer(), U) for z in rows.column(6)]
            items, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            common = df > 1
            column = np.cumsum(common) - 1
            owner, place = owner[common[place]], column[place[common[place]]]
            order = np.argsort(place, kind="stable")
            owner, place = owner[order], place[order]
            inter = np.zeros((len(sets), len(sets)), np.float64)
            for lo in range(0, int(common.sum()), COLUMNS):
                a, b = np.searchsorted(place, (lo, lo + COLUMNS))
                part = np.zeros((len(sets), COLUMNS), np.float32)
                part[owner[a:b], place[a:b] - lo] = 1
                inter += part @ part.T
            both = inter[i, j]
            good = 100 * both >= LINK * (n[i] + n[j] - both)
            links = np.zeros((len(sets), len(sets)), bool)
            links[i[good], j[good]] = links[j[good], i[good]] = True
            # a spanning forest says as much as all links
            new, us, vs = links.any(1), [], []
            while new.any():
                queue = [int(np.flatnonzero(new)[0])]
                new[queue[0]] = False
                while queue:
                    u = queue.pop()
                    for v in np.flatnonzero(links[u] & new).tolist():
                        new[v] = False
                        us.append(min(ids[u], ids[v]))
                        vs.append(max(ids[u], ids[v]))
                        queue.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    key = "bucket long, x long, y long, id long, n long, label long"
    sketch = present(own.select("id", "low", "keys"), multi.select("id").distinct())
    rows = block_pairs(multi, files).hint("merge").join(sketch.hint("merge"), "id").select("bucket", "x", "y", "id", "n", "label", "low", "keys")
    rest = staged(_runs(rows).mapInArrow(sketched, key), "rest", files=files)
    if not rest.limit(1).count():
        return rest.select(F.col("id").alias("u"), F.col("id").alias("v"))
    full = with_sets(docs, rest).select("bucket", "x", "y", "id", "n", "label", "items")
    return staged(_runs(full).mapInArrow(compared, "u long, v long").distinct(), "links", files=files)


def linked(multi: DataFrame, own: DataFrame, docs: DataFrame, files: int = 0) -> DataFrame:
    """id, label for the classes that have a link. multi: bucket, id, n, pop, size; own: id, n, low, keys; docs: one row
    for each text of a doc_id."""
    multi, links, turn = multi.withColumn("label", F.col("id")), None, 0
    while turn < HUB_ROUNDS:
        pairs = staged(_stars(multi, F.xxhash64("bucket", "id", F.lit(turn)) if turn else F.col("pop")), "stars", files=files)
        pairs = staged(likely(pairs, own), "pairs", files=files)
        if turn and not pairs.limit(1).count():
            break
        new = staged(confirmed(pairs, docs), "links", files=files)
        if turn and not new.limit(1).count():
            break
        links, turn = new if links is None else links.unionByName(new), turn + 1
        found = components(links, files).withColumnRenamed("v", "id")
        labelled = multi.drop("label").join(found, "id", "left").withColumn("label", F.coalesce("label", "id"))
        # buckets that lie in one component are done
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        multi = staged(labelled.join(open_, "bucket", "left_semi"), "multi", files=files)
    new = all_links(multi, own, docs, files)
    return components(links.unionByName(new), files).withColumnRenamed("v", "id") if new.limit(1).count() else found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Words are cut at ASCII white space after A-Z are lower-cased. Documents without words (also null texts) link with
    nothing. A null doc_id stands for itself: its component_id is null and it is kept. Rows that repeat a doc_id with
    other texts take the smallest component of any of them. Texts are taken whole, however long. Other columns are not
    read."""
    sketched = staged(sketches(docs).withColumn("row", F.monotonically_increasing_id()), "sketches")
    files = pieces(sketched)
    classes = sketched.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"))
    classes = staged(classes, "classes", files=files)
    # one row for each class, also where rows repeat
    rows = sketched.select(F.col("doc_id").alias("id"), "a", "b", "row").join(classes, ["id", "a", "b"], "left_semi").groupBy("a", "b").agg(F.min("row").alias("row"))
    reps = staged(sketched.select(F.col("doc_id").alias("id"), "n", "bands", "low", "row").join(rows.select("row"), "row", "left_semi").drop("row"), "reps")
    members = reps.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(members.join(sizes, "bucket"), "shared", files=files)
    pop = shared.groupBy("id").agg(F.sum("size").alias("pop"))
    multi = staged(shared.join(pop, "id"), "members", files=files)
    repeats = sketched.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    texts = docs.dropDuplicates(["doc_id", "text"]) if repeats else docs
    keys = F.transform("bands", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int"))
    found = linked(multi, reps.select("id", "n", "low", keys.alias("keys")), texts, files)
    top = classes.join(found, "id", "left").select("a", "b", F.coalesce("label", "id").alias("component"))
    rows = sketched.select("doc_id", "n", "a", "b").join(top, ["a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns. Rows with equal doc_id (or null) and equal text are one document and
    stay once; rows of a kept doc_id with several texts stay once for each text."""
    kept = staged(near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count(F.lit(1)).alias("__rows")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id"))
    again = F.col("__kept_id").isNull() | (F.col("__rows") > 1)
    if not kept.where(again).limit(1).count():
        return docs.join(kept, same, "left_semi")
    return docs.join(kept.where(~again), same, "left_semi").unionByName(docs.join(kept.where(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))

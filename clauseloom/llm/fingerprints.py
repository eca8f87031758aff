"""Document fingerprints: a canonical exact digest.

A text's canonical form has canonical Unicode composition (NFC), full case folding, and every run of white space as one
space, none at the ends. The fingerprint is 128 bits of xxhash over that form, as hex. Documents are grouped by it, and
inside a group the canonical forms themselves are compared byte by byte: grouping is by hash and form, so a form that
shares its hash with another one is told apart and gets a number behind the hash (the forms of a hash in byte order,
the first without a number).

Only DataFrame and SQL functions are used; composition and folding are static methods of the ICU library that Spark
ships, called by ``java_method``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SALT = "clauseloom"


def canonical(text: Column) -> Column:
    """The canonical form; a null text is empty."""
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text.cast("string"), F.lit(""))), F.lit(True))
    # folding can leave a form that composes again
    return F.trim(F.regexp_replace(compose(folded), r"[\s\p{Z}\x{85}]+", " "))


def wide_hash(form: Column) -> Column:
    """128 bits of a canonical form, as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SALT), form)), 16, "0")))


def _byte_key(form: Column) -> Column:
    """SHA-256 of the form's bytes, which stands for them when forms of one hash are compared."""
    return F.unhex(F.sha2(form.cast("binary"), 256))


def clashes(keys: DataFrame) -> DataFrame:
    """hash, byte_key, number of the forms that share their hash with a form before them: no row unless xxhash
    collides. keys: hash, byte_key of any rows; copies are summed before the forms are dealt out."""
    distinct = keys.select("hash", "byte_key").distinct()
    several = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("hash")
    inside = distinct.join(several, "hash", "left_semi")
    return inside.withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("byte_key")) - 1).where("number > 0")


def _numbered(rows: DataFrame, hash_: str, byte_key: str, name: str, odd: DataFrame) -> DataFrame:
    """``rows`` with the fingerprint ``name`` of the hash and byte key in the two columns. odd: the forms with a number;
    where there is none, nothing is joined."""
    if odd.limit(1).count():
        rows = rows.join(odd.select(F.col("hash").alias(hash_), F.col("byte_key").alias(byte_key), F.concat(F.lit("-"), F.col("number").cast("string")).alias("__number")), [hash_, byte_key], "left")
        return rows.withColumn(name, F.concat(hash_, F.coalesce("__number", F.lit("")))).drop("__number")
    return rows.withColumn(name, F.col(hash_))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), hash, byte_key; the canonical form is made once for each text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    formed = own.withColumn("form", canonical(F.col("text")))
    return formed.select("doc_id", "text", wide_hash(F.col("form")).alias("hash"), _byte_key(F.col("form")).alias("byte_key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for every row of ``docs``; equal texts, and texts with equal canonical forms, have equal
    fingerprints, others different ones."""
    rows = staged(_keyed(docs).drop("text"), "fingerprints")
    return _numbered(rows, "hash", "byte_key", "fingerprint", clashes(rows)).select("doc_id", "fingerprint")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, first_id (the smallest doc_id with that fingerprint), copies."""
    own = fingerprints(docs)
    each = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return own.join(each, "fingerprint").select("doc_id", "fingerprint", "first_id", "copies")


def with_next(docs: DataFrame, buckets: int = 0) -> DataFrame:
    """doc_id, text, hash, byte_key, next_text and next_key: the text and byte key of the next row in order of (doc_id,
    text), the first row's after the last.

    Rows are dealt by ranges of doc_id whose bounds are quantiles, so that no task orders the whole table; a copy of
    each range's first row closes the range before it."""
    own = _keyed(docs)
    buckets = buckets or 4 * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"]
    cuts = sorted(set(found or []))
    place = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    dealt = own.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(place))
    # at most buckets + 1 rows of numbers: the first doc_id of each range, and the range before it in the ring
    ring = Window.orderBy("bucket")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = dealt.select("bucket", "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("first_id")).select(F.col("bucket").alias("b"), "first_id", F.coalesce(F.lag("bucket").over(ring), F.last("bucket").over(every)).alias("before"))
    same = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    heads = dealt.join(F.broadcast(first), same).groupBy("before").agg(F.min(F.struct("text", "byte_key")).alias("h"))
    closing = heads.select(F.lit(None).cast("long").alias("doc_id"), "h.text", F.lit(None).cast("string").alias("hash"), "h.byte_key", F.col("before").alias("bucket"), F.lit(True).alias("closing"))
    order = Window.partitionBy("bucket").orderBy("closing", "doc_id", "text")
    rows = dealt.withColumn("closing", F.lit(False)).unionByName(closing).withColumns({"next_text": F.lead("text").over(order), "next_key": F.lead("byte_key").over(order)})
    return rows.where(~F.col("closing")).drop("closing", "bucket")


def edited_report(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    text. The likeness of two exact digests is 1 where the canonical forms are the same bytes, else 0. A null text is
    empty; repeated rows stay rows; a single row is its own next one; other columns are not read."""
    half = "cast(floor(length(text) / 2) as int)"
    edited = F.expr(f"concat(left(text, length(text) - {half}), left(next_text, {half}))")
    pairs = with_next(docs).withColumns({"edited": edited, "n_chars": F.length("text").cast("long")}).drop("text", "next_text")
    forms = pairs.withColumn("form", canonical(F.col("edited")))
    rows = staged(
        forms.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "hash", "byte_key", "next_key", wide_hash(F.col("form")).alias("edited_hash"), _byte_key(F.col("form")).alias("edited_key")),
        "fingerprints",
    )
    # the forms of texts and edited texts are numbered together
    odd = clashes(rows.select("hash", "byte_key").unionByName(rows.select(F.col("edited_hash").alias("hash"), F.col("edited_key").alias("byte_key"))))
    near = lambda key: (F.col("byte_key") == F.col(key)).cast("double")
    rows = rows.withColumns({"near_edited": near("edited_key"), "near_next": near("next_key")})
    rows = _numbered(_numbered(rows, "hash", "byte_key", "fingerprint", odd), "edited_hash", "edited_key", "edited_fingerprint", odd)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

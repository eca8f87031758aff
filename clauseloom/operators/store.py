"""Stored tables: upserts, deletions, renames, logs, staleness, listings and index checks over Parquet.

Parquet has no MERGE: an upsert writes a new version of the table beside the old one and then moves a pointer file in
one step, so that readers see the old or the new version and a lost executor costs only its task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

FILTER_FIELDS = ("doc_id", "plan_id", "plan_year", "type", "section_path", "states", "carrier", "market_segment")


class Table:
    """A versioned Parquet table. The pointer is a one-row Parquet folder, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self.fs.exists(self.fs_path):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path)]
        return sorted(n for n in names if n.startswith("v") and self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def write(self, df: DataFrame) -> DataFrame:
        """A version counts once its _SUCCESS file is there."""
        n = int(self._versions()[-1][1:9]) + 1 if self._versions() else 0
        df.write.parquet(f"{self.path}/v{n:08d}-{uuid.uuid4().hex[:8]}")
        return self.read()

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace rows by key (of rows with equal keys the greatest, column by column); returns how many are new
        or changed."""
        old = self.read()
        rest = [c for c in rows.columns if c != self.key]
        text = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in rows.dtypes if c != self.key]
        order = Window.partitionBy(self.key).orderBy(*(c.desc_nulls_last() for c in text))
        new = rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").select(*rows.columns) if rest else rows.distinct()
        if old is None:
            return self.write(new).count()
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in new.columns if c in old.columns]
        changed = new.alias("n").join(old.alias("o"), F.col(f"n.{self.key}") == F.col(f"o.{self.key}"), "left").where(F.col(f"o.{self.key}").isNull() | ~F.reduce(F.array(*same), F.lit(True), lambda a, b: a & b)).count()
        kept = old.join(new.select(self.key), self.key, "left_anti")
        self.write(kept.unionByName(new, allowMissingColumns=True))
        return changed

    def delete(self, condition) -> int:
        old = self.read()
        gone = old.where(condition).count()
        if gone:
            self.write(old.where(~F.coalesce(condition, F.lit(False))))
        return gone


def projected(chunks: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Chunks as readers get them: ``_id`` is chunk_id, and the embedding never comes along (its column is not read);
    ``columns`` picks others."""
    named = chunks.withColumnRenamed("_id", "chunk_id").drop("embedding")
    return named.select("chunk_id", *columns) if columns else named


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """Chunks with embedding, embed_model, embed_dim, embedded_at, joined on chunk_id; a vector of another size, or a
    chunk without one, raises when the row is read."""
    x = chunks.drop("embedding").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    ok = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no vector of the model's size for "), "chunk_id")))
    return x.withColumns({"embedding": ok, "embed_model": F.lit(model), "embed_dim": F.lit(dim), "embedded_at": F.current_timestamp()})


def renamed(chunks: DataFrame, old: str, new: str) -> DataFrame:
    """The chunks of document ``old`` under the id ``new``, with new chunk ids; raises if ``new`` exists."""
    if chunks.where(F.col("doc_id") == new).limit(1).count():
        raise ValueError(f"{new} exists")
    return chunks.withColumn("doc_id", F.when(F.col("doc_id") == old, new).otherwise(F.col("doc_id"))).withColumn("chunk_id", F.when(F.col("doc_id") == new, T.chunk_id("doc_id", "seq")).otherwise(F.col("chunk_id")))


def list_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, plan_id and plan_year of the first chunk, chunks, pages, tables, needs_review."""
    return chunks.groupBy("doc_id").agg(
        F.min_by("plan_id", "seq").alias("plan_id"), F.min_by("plan_year", "seq").alias("plan_year"), F.count(F.lit(1)).alias("chunks"),
        F.max("page_end").alias("pages"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if("needs_review").alias("needs_review"),
    )


def needing_review(chunks: DataFrame, limit: int = 100) -> DataFrame:
    return chunks.where("needs_review").orderBy("doc_id", "seq").limit(limit)


def stale(chunks: DataFrame, version: str, config_hash: str | None = None) -> DataFrame:
    """Chunks made by another version or configuration; a missing value counts as another."""
    other = ~F.col("pipeline_version").eqNullSafe(F.lit(version))
    return chunks.where(other | ~F.col("chunk_config_hash").eqNullSafe(F.lit(config_hash)) if config_hash else other)


def not_stored(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet: what a resumed load has left to do."""
    return chunks.join(stored.select("chunk_id"), "chunk_id", "left_anti")


def stamped(chunks: DataFrame, context: DataFrame) -> DataFrame:
    """Chunks with their document's plan identity and provenance (a small dimension table, joined on doc_id)."""
    return chunks.join(context, "doc_id", "left")


def with_dates(df: DataFrame, *columns: str) -> DataFrame:
    """ISO texts as timestamps in <column>_at; the text stays, also where it cannot be read."""
    return df.withColumns({f"{c}_at": T.to_utc(c) for c in columns})


def by_source_hash(records: DataFrame, sha256: str) -> DataFrame:
    return records.where(F.col("source_sha256") == sha256).limit(1)


def append_log(log: DataFrame, path: str) -> None:
    """Append query-log rows; asked_at is set where it is missing."""
    asked = F.coalesce("asked_at", F.current_timestamp()) if "asked_at" in log.columns else F.current_timestamp()
    log.withColumn("asked_at", asked).write.mode("append").parquet(path)


def index_status(chunks: DataFrame, dim: int, expected=FILTER_FIELDS) -> dict:
    """missing filter fields, rows without a vector and rows with one of another size."""
    x = chunks.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("embedding").isNull()).alias("without"), F.count_if(F.size("embedding") != dim).alias("other_size")).first() if "embedding" in chunks.columns else None
    return {"missing_fields": [f for f in expected if f not in chunks.columns], "rows": x["rows"] if x else chunks.count(), "without_vector": x["without"] if x else None, "other_size": x["other_size"] if x else None}


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def token_estimate(chunks: DataFrame, dim: int) -> DataFrame:
    """chunks, tokens and vector_mb (8 bytes a number) of a table."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_tokens").alias("tokens"), F.round(F.count(F.lit(1)) * dim * 8 / 1048576, 3).alias("vector_mb"))

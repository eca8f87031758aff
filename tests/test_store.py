"""Stored tables, readers, configuration, models and streams."""

import json

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import embed
from clauseloom.operators import search, store
from clauseloom.plans import flows
from clauseloom.sources import readers
from clauseloom.streaming import ingest

ROW = "chunk_id string, doc_id string, seq int, text string"


def rows(spark, *xs):
    return spark.createDataFrame(list(xs), ROW)


def test_upsert_delete_rename(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), "chunk_id")
    assert t.read() is None
    assert t.upsert(rows(spark, ("a", "d", 0, "x"), ("b", "d", 1, "y"))) == 2
    assert t.upsert(rows(spark, ("b", "d", 1, "y"), ("c", "d", 2, None))) == 1
    assert t.upsert(rows(spark, ("b", "d", 1, "new"))) == 1
    assert {(r.chunk_id, r.text) for r in t.read().collect()} == {("a", "x"), ("b", "new"), ("c", None)}
    assert t.delete(F.col("text") == "x") == 1 and t.read().count() == 2
    moved = store.renamed(t.read(), "d", "e")
    assert {r.doc_id for r in moved.collect()} == {"e"} and all(r.chunk_id.startswith("e#") for r in moved.collect())
    with pytest.raises(ValueError):
        store.renamed(t.read(), "x", "d")


def test_embeddings_and_status(spark):
    c = rows(spark, ("a", "d", 0, "hot tubs"), ("b", "d", 1, "bath chairs")).withColumn("embed_text", F.col("text"))
    vectors = embed.embedded(c, lambda: embed.HashEmbedder(8))
    full = store.attach_embeddings(c, vectors, "hashing", 8)
    assert all(len(r.embedding) == 8 and r.embed_dim == 8 for r in full.collect())
    with pytest.raises(Exception, match="no vector"):
        store.attach_embeddings(c, vectors.where("chunk_id = 'a'"), "hashing", 8).collect()
    status = store.index_status(full, 9)
    assert status["other_size"] == 2 and "plan_id" in status["missing_fields"]


def test_retries_and_batches():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError("timed out")
        return 7

    assert embed.with_retries(flaky, sleep=waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        embed.with_retries(lambda: (_ for _ in ()).throw(ValueError("bad")), sleep=waits.append)
    got = list(embed.batches(["a" * 100_000, "b" * 100_000, "c" * 100_000] + ["d"] * 200))
    assert [len(b) for b in got] == [2, 96, 96, 9] and sum(map(len, got)) == 203
    with pytest.raises(ValueError):
        embed.embedder("elsewhere")


def test_model_answers(spark):
    said = ['```json\n{"descriptor": "Tub", "synonyms": ["spa"], "confidence": "high"}\n```', "no json here"]
    got = embed.described(spark.createDataFrame([(s,) for s in said], "answer string")).collect()
    assert (got[0].descriptor, got[0].synonyms, got[0].uncertain) == ("Tub", ["spa"], False)
    assert (got[1].descriptor, got[1].uncertain) == ("no json here", True)


def test_readers(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("﻿code,system,descriptor,synonyms\n15830,CPT,Skin,a|b\n 15830 ,,Later,c| \ne66.01,,Obesity,\n,cpt,blank,\n", encoding="utf-8")
    got = {r.code: (r.system, r.descriptor, r.synonyms) for r in readers.codes(spark, str(tmp_path / "codes.csv")).collect()}
    assert got == {"15830": ("cpt", "Later", ["c"]), "E66.01": ("icd10", "Obesity", [])}
    (tmp_path / "cases.csv").write_text('code,descriptor,synonyms,expected\nE1300,"Whirlpool, portable","hot tub; spa",supported\n,x,,\n')
    assert [r.synonyms for r in readers.cases(spark, str(tmp_path / "cases.csv")).collect()] == [["hot tub", "spa"]]
    (tmp_path / "plan.md").write_text("# A\n\ntext")
    assert [tuple(r) for r in readers.markdown(spark, str(tmp_path / "plan.md")).collect()] == [("plan", "# A\n\ntext")]
    (tmp_path / "tables.json").write_text(json.dumps([{"table_id": "t1", "n_rows": 3, "cells": [{"row": 0, "col": 0, "text": "x"}]}, {"n_rows": 1}]))
    assert [r.table_id for r in readers.structures(spark, str(tmp_path / "tables.json")).collect()] == ["t1"]
    (tmp_path / "chunks.jsonl").write_text('{"chunk_id": "x", "doc_id": "old", "seq": 3, "text": "t"}\n')
    assert [(r.doc_id, r.chunk_id[:9]) for r in readers.chunks(spark, str(tmp_path / "chunks.jsonl"), "new").collect()] == [("new", "new#00003")]
    assert len(readers.file_hashes(spark, str(tmp_path / "plan.md")).first().sha256) == 64


def test_config():
    c = readers.config("chunking:\n  max_tokens: 500  # less\nplan:\n  states: [CO, TX]\n  plan_id: 'p'\n", {"CLAUSELOOM_MAX_TOKENS": "700", "CLAUSELOOM_TARGET_TOKENS": "300"}, overlap_tokens=9)
    assert (c.max_tokens, c.target_tokens, c.overlap_tokens, c.states, c.plan_id) == (500, 300, 9, ("CO", "TX"), "p")
    for bad in ("storage:\n  mongodb_uri: x\n", "nonsense: 1\n"):
        with pytest.raises(ValueError):
            readers.config(bad, {})
    assert not c.allows("review", 80.0) and readers.config("", {}, allow_review=True).allows("review", 80.0)


def test_ask(spark):
    table = spark.createDataFrame([(f"c{k}", "d", k, "text", f"Part {k}", f"alpha{k} beta gamma", k + 1, k + 1, None, None, None) for k in range(12)], "chunk_id string, doc_id string, seq int, type string, breadcrumb string, text string, page_start int, page_end int, printed_start int, printed_end int, form_code string").withColumn("embed_text", F.col("text"))
    model = embed.HashEmbedder(16)
    vectors = embed.embedded(table, lambda: embed.HashEmbedder(16))
    sources = flows.retrieve(table, vectors, ["alpha4", ""], model, k=2)
    first = sorted((r.place, r.chunk_id) for r in sources.where("query_id = 0").collect())
    assert first[0][1] == "c4" and {"c3", "c5"} <= {c for _, c in first}
    said = flows.ask(sources.where("query_id = 0"), ["alpha4", "nothing"], lambda q, c: f"{q}|{c.splitlines()[0]}")
    assert said == ["alpha4|[1] Part 4, p. 5", flows.EMPTY]
    with pytest.raises(ValueError):
        search.vector_topk(vectors, spark.range(2000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("query")), 3)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows(spark, ("a", "d", 0, "x"), ("b", "d", 1, "y")).write.parquet(src)
    t = store.Table(spark, str(tmp_path / "t"), "chunk_id")
    for _ in range(2):
        ingest.upsert_stream(spark.readStream.schema(ROW).parquet(src), t, str(tmp_path / "ck")).awaitTermination()
    assert t.read().count() == 2
    ingest.append_stream(spark.readStream.schema(ROW).parquet(src), str(tmp_path / "log"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    store.append_log(spark.createDataFrame([("q",)], "question string"), str(tmp_path / "asked"))
    assert spark.read.parquet(str(tmp_path / "asked")).first().asked_at is not None


def test_streamed_windows(spark, tmp_path):
    path = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0 value, 1 user_id union all select timestamp'2024-01-01 00:50:00', 'a', 2.0, 1").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.events, r.total) for r in spark.table("windows").collect()] == [(2, 3.0)]
    assert ingest.sessions(spark.read.parquet(path)).count() == 2

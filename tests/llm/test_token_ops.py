import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseloom.llm import token_counts, token_output
from clauseloom.llm.common import BATCH_KEY, small_batches
from clauseloom.llm.idcoder import CorruptBlock

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, start string, section string"
TEXTS = ["Plain words.\nSecond line\n\n\nthird", "", None, "\n", "no break", "ends\n", "naïve 中文 🙂\nça", "a" * 700 + "\n" + "b c " * 900, "x<|endoftext|>y", "  \n\n  two"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "t") for i, t in rows], SCHEMA)


def brute_sections(text, rule):
    text = text or ""
    cuts, at = [], 0
    for part in text.splitlines(keepends=True) if "\n" in text else [text]:
        at += len(part)
        cuts.append(at)
    cuts = cuts or [0]
    bounds = list(zip([0, *cuts[:-1]], cuts, strict=True))
    n, touch = [0] * len(bounds), [0] * len(bounds)
    for lo, hi in LIB.encode(text, add_special_tokens=False).offsets:
        over = [max(0, min(hi, b) - max(lo, a)) for a, b in bounds]
        hit = [k for k, o in enumerate(over) if o]
        n[{"largest": over.index(max(over)), "first": hit[0], "last": hit[-1]}[rule]] += 1
        if len(hit) > 1:
            for k in hit:
                touch[k] += 1
    return [(k, a, b, n[k], touch[k]) for k, (a, b) in enumerate(bounds)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_as_brute_force(spark, rule):
    rows = [(10 - i, t) for i, t in enumerate(TEXTS)] + [(None, "q\nr")]
    got = token_counts.section_tokens(frame(spark, rows), PATH, rule=rule).collect()
    want = sorted(((i, *s) for i, t in rows for s in brute_sections(t, rule)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_fields_and_edges(spark):
    df = spark.createDataFrame([(1, "one two", None, "three")], "doc_id long, a string, b string, c string")
    got = sorted(token_counts.section_tokens(df, PATH, ("a", "b", "c")).collect())
    assert [(r.section, r.char_start, r.char_end) for r in got] == [(0, 0, 8), (1, 8, 9), (2, 9, 14)]
    assert sum(r.n_tokens for r in got) == len(LIB.encode("one two\n\nthree").ids)
    assert token_counts.section_tokens(frame(spark, []), PATH).collect() == []
    with pytest.raises(ValueError):
        token_counts.section_tokens(df, PATH, rule="half")


def brute_files(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 22])
def test_files_as_brute_force(spark, block_ids):
    rows = [(7 * i % 23, t) for i, t in enumerate(TEXTS * 2)] + [(None, "z"), (3, "copy"), (3, "copy")]
    files = token_output.staged(token_output.encode_documents(frame(spark, rows).repartition(5), PATH, block_ids=block_ids), "t")
    assert sorted(map(tuple, token_output.decode_documents(files).collect()), key=str) == sorted(brute_files(rows), key=str)
    ids = {(r.doc_id, r.start): r.ids for r in token_output.decode_documents(files, ids=True).collect()}
    assert ids[(None, 0)] == [*LIB.encode("z").ids, 0]


def test_damage_and_empty_tables(spark):
    assert token_output.write_and_read(frame(spark, []), PATH).collect() == []
    files = token_output.encode_documents(frame(spark, [(1, "some words here")]), PATH)
    for column in ("payload", "index"):
        bad = token_output.staged(files.withColumn(column, F.concat(F.expr(f"substring({column}, 1, octet_length({column}) - 1)"), F.unhex(F.lit("a7")))), "bad")
        with pytest.raises(Exception, match=CorruptBlock.__name__):
            token_output.decode_documents(bad).collect()


def test_batches_to_workers_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    df = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("words "), 500).alias("text"))
    spark.conf.unset(BATCH_KEY)
    small_batches(spark)
    got = df.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 9000 and max(r.size for r in got) < 5_000_000
    spark.conf.set(BATCH_KEY, "1m")
    small_batches(spark)
    assert spark.conf.get(BATCH_KEY) == "1m"
    spark.conf.unset(BATCH_KEY)

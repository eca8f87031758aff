import hashlib
import unicodedata

import pytest
import xxhash

from clauseloom.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def canonical(text):
    nfc = lambda s: unicodedata.normalize("NFC", s)
    return " ".join(nfc(nfc(text or "").casefold()).split())


def digest(text):
    form = canonical(text).encode()
    second = xxhash.xxh64_intdigest(form, seed=xxhash.xxh64_intdigest(fp.SALT.encode(), seed=42))
    return f"{xxhash.xxh64_intdigest(form, seed=42):016x}{second:016x}"


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(nxt))))
    return out


@pytest.mark.parametrize("buckets", [2, 5, 40])
def test_report_as_brute_force(spark, buckets, monkeypatch):
    texts = ["Hello  World", "hello world", "Stra\u00dfe", "STRASSE", "e\u0301t\u00e9", "\u00c9t\u00e9", "", None, "x", "a\tb\n", "\U0001f642\U0001f643", "abc" * 4000, "zz", "zz", "zz"]
    rows = [(7 * i % 31, t) for i, t in enumerate(texts)]
    own = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda d: own(d, buckets))
    got = fp.edited_report(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_groups_and_collisions(spark, monkeypatch):
    rows = [(5, "A  b"), (3, "a b"), (9, "c"), (11, None), (12, " ")]
    assert {(r.doc_id, r.first_id, r.copies) for r in fp.groups(frame(spark, rows)).collect()} == {(5, 3, 2), (3, 3, 2), (9, 9, 1), (11, 11, 2), (12, 11, 2)}
    from pyspark.sql import functions as F

    monkeypatch.setattr(fp, "wide_hash", lambda form: F.substring(form, 1, 1))  # everything with the same first letter collides
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(frame(spark, [(1, "ab"), (2, "AB"), (3, "ac"), (4, "ad"), (5, "b")])).collect()}
    assert got[1] == got[2] and len({got[k] for k in (1, 3, 4, 5)}) == 4


def test_edges(spark):
    assert fp.edited_report(frame(spark, [])).collect() == []
    one = fp.edited_report(frame(spark, [(4, "abcd")])).collect()
    assert [tuple(r) for r in one] == brute([(4, "abcd")])
    twice = fp.edited_report(frame(spark, [(4, "abcd"), (4, "abcd"), (None, "q")])).collect()
    assert sorted(map(str, map(tuple, twice))) == sorted(map(str, brute([(4, "abcd"), (4, "abcd"), (None, "q")])))

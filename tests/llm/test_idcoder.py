import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseloom.llm import idcoder
from clauseloom.llm.idcoder import CorruptBlock, decode_block, encode_block


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1023, 2048, 5001])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.2, n) % 50_000, np.full(n, 7), np.arange(n) % 3, rng.integers(0, 1 << 20, n)):
        assert decode_block(encode_block(ids)).tolist() == ids.tolist()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=800))
def test_any_ids(ids):
    assert decode_block(encode_block(np.array(ids, np.int64))).tolist() == ids


def test_repeats_cost_little_and_damage_is_seen():
    ids = np.tile(np.arange(100), 300)
    block = encode_block(ids)
    assert len(block) < len(ids) // 4
    for at in (4, 20, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(CorruptBlock):
            decode_block(bytes(bad))
    with pytest.raises(CorruptBlock):
        decode_block(block[:-3])
    with pytest.raises(ValueError):
        encode_block(np.array([-1]))


def test_bits_an_id_of_text():
    """Ids of real prose at sf0.01: less than order 0 could give (8.3 bits), and less than 6.5."""
    import os

    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("the test tables are not here")
    from clauseloom.llm.bytebpe import PieceEncoder
    from clauseloom.llm.queries import tokenizer_path

    texts = [t or "" for (t,) in duckdb.sql(f"SELECT text FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}') ORDER BY doc_id").fetchall()]
    ids, sizes, *_ = PieceEncoder(tokenizer_path()).encode(texts)
    ids = np.insert(ids, np.cumsum(sizes), 0)
    block = encode_block(ids)
    assert (decode_block(block) == ids).all()
    assert len(block) * 8 / len(ids) < 6.5


def test_few_steps_and_one_sort_an_epoch():
    """A full block takes 512 steps, and an epoch's pairs are found and counted from one sort."""
    rng = np.random.default_rng(1)
    lanes, steps = idcoder._lanes(1 << 22)
    assert lanes * steps == 1 << 22 and steps <= 512 and idcoder.MAX_LANES * idcoder.EPOCH_STEPS <= 1 << 19
    m = idcoder.Model(300)
    for _ in range(3):
        p1, v = (rng.zipf(1.3, 5000).astype(np.int32) % 300 for _ in range(2))
        located = m.locate(p1, v)
        found, key = m.find(located), p1.astype(np.int64) * 300 + v
        known = np.isin(key, m.keys)
        assert ((found >= 0) == known).all() and (m.keys[found[known]] == key[known]).all()
        m.seen.append(np.zeros(1, np.int64))
        before = dict(zip(m.keys.tolist(), m.counts.tolist(), strict=True))
        m.close_epoch(v, located)
        for k, n in zip(*np.unique(key, return_counts=True), strict=True):
            before[int(k)] = before.get(int(k), 0) + int(n)
        assert dict(zip(m.keys.tolist(), m.counts.tolist(), strict=True)) == before and (np.diff(m.keys) > 0).all()

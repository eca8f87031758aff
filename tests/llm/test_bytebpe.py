import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clauseloom.llm import bytebpe
from clauseloom.llm.bytebpe import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB, OWN = Tokenizer.from_file(PATH), PieceEncoder(PATH, spans=True)
ODD = st.text(st.sampled_from(list("aZs é'tlmrvd  \n\t\r12٣½.,!?%_-🙂́ß中   \u0085\x1c\x0b")), max_size=40)


def same(texts):
    ids, counts, lo, hi = OWN.encode(texts)
    found = LIB.encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(e.ids) for e in found]
    assert ids.tolist() == [x for e in found for x in e.ids]
    assert list(zip(lo.tolist(), hi.tolist(), strict=True)) == [x for e in found for x in e.offsets]


@settings(max_examples=400, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_as_the_library_on_odd_texts(texts):
    same(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_as_the_library_on_any_text(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    same(texts)


@pytest.mark.parametrize("texts", [[], ["", ""], ["I'll 's 'some don't!'s", "it's"], ["a<|endoftext|>b"], ["x" * 3000, "a"], [" ", "  a", "a  ", "a \n b"]])
def test_edges(texts):
    same(texts)


def test_many_slices_and_a_full_table(monkeypatch):
    """Late pieces join the table in bulk; past its limit it starts anew."""
    monkeypatch.setattr(bytebpe, "TABLE_PIECES", 700)
    for spans in (False, True):
        own = PieceEncoder(PATH, spans)
        for k in range(30):
            texts = [" ".join(f"w{(i * 37 + k * 11) % 997}x{i % 7}" for i in range(80)), "", f"slice {k}"]
            ids, counts, *_ = own.encode(texts)
            found = LIB.encode_batch(texts, add_special_tokens=False)
            assert ids.tolist() == [x for e in found for x in e.ids] and counts.tolist() == [len(e.ids) for e in found]
            assert len(own.known[0][0]) + len(own.known[1][0]) == own.n <= 700
            assert len(own.known[1][0]) <= max(1, len(own.known[0][0]) // 8)

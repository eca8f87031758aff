"""Fast exact encoding with a byte-level BPE of the ``tokenizers`` library.

A byte-level BPE cuts a text into pieces by a fixed pattern and merges inside pieces only. The cut is done
here with numpy over character classes; each distinct piece goes through the library once and its ids and
character offsets are kept in a bounded table, so that common pieces cost a lookup. Any other tokenizer, and
any text that holds an added token's string, goes through the library as a whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The suffixes that the pattern takes together with an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces kept in the table; beyond it the table starts anew.
TABLE_PIECES = 1_200_000
#: Byte-level alphabets write printable bytes of Latin-1 as themselves and the others, in order, from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = np.arange(256, dtype="<u4")
BYTE_CHARS[sorted(set(range(256)) - set(PRINTABLE))] = 0x100 + np.arange(256 - len(PRINTABLE))
#: Odd bases of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: A class not looked up yet is 255.
_CLASSES = np.full(0x110000, 255, np.uint8)


def classes(cp: np.ndarray) -> np.ndarray:
    """The class of each code point; the table is filled in pages of 256 as they occur."""
    found = _CLASSES[cp]
    if len(cp) and found.max() == 255:
        for page in np.unique(cp[found == 255] >> 8).tolist():
            for c in range(page << 8, (page + 1) << 8):
                kind = unicodedata.category(chr(c))[0]
                _CLASSES[c] = SPACE if c in WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        found = _CLASSES[cp]
    return found


@functools.lru_cache(4)
def powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, 2^bits of each."""
    each = lambda x: np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << bits) - 1, x, np.uint64)))
    return each(base), each(pow(base, -1, 1 << 64))


def piece_hash(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of each piece, from running sums over the values (64 bits) of all code points."""
    up, down = powers(base, max(20, int(len(value)).bit_length()))
    run = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * up[: len(value)], out=run[1:])
    return (run[ends] - run[starts]) * down[starts]


def piece_starts(big: str, cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions in ``big`` (code points ``cp``) where a piece begins; bounds: where each text begins, and the end."""
    n = len(big)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes(cp)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = first.copy()
    change = cls[1:] != cls[:-1]
    attached = (cp[:-1] == 32) & (cls[1:] != SPACE)
    start[1:n] |= change & ~attached
    # the last white-space character before something else of the same text stands by itself or joins what follows
    start[: n - 1] |= (cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~first[1:n]
    quote = np.flatnonzero((cp == 39) & start[:n])
    for i in quote[quote < n - 1].tolist():
        if start[i + 1] and not first[i + 1] and cls[i + 1] == LETTER:
            for suffix in SUFFIXES:
                end = i + 1 + len(suffix)
                if big.startswith(suffix, i + 1) and not first[i + 2 : end].any():
                    start[i + 1] = False
                    if end < n and cls[end] == LETTER:
                        start[end] = True
                    break
    return np.flatnonzero(start[:n])


class PieceEncoder:
    """Encodes lists of texts to flat arrays of ids, with the ids' character spans on demand."""

    def __init__(self, path: str, spans: bool = False):
        from tokenizers import Tokenizer

        self.spans = spans
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self._reset()

    def _reset(self) -> None:
        #: the hashes of the pieces, sorted, with their rows: most of them, and the late ones, which join them in bulk
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        #: of each row the second hash and where its ids begin and end; the arrays have room at their ends
        self.n = self.n_ids = 0
        self.checks, self.at = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.ids, self.lo, self.hi = (np.zeros(0, np.int32) for _ in range(3))

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into the array ``name`` from ``at`` on; it grows by doubling."""
        held = getattr(self, name)
        if at + len(values) > len(held):
            more = np.empty(max(2 * len(held), at + len(values)), held.dtype)
            more[:at] = held[:at]
            setattr(self, name, more)
        getattr(self, name)[at : at + len(values)] = values

    def _rows(self, key: np.ndarray) -> np.ndarray:
        """The rows of the sorted keys; -1 for new ones."""
        out = np.full(len(key), -1, np.int64)
        for keys, rows in self.known:
            at = np.searchsorted(keys, key)
            found = at < len(keys)
            found[found] = keys[at[found]] == key[found]
            out[found] = rows[at[found]]
        return out

    def _remember(self, key: np.ndarray, rows: np.ndarray) -> None:
        """Add sorted new keys to the late ones."""
        join = lambda a, b: tuple(np.insert(x, np.searchsorted(a[0], b[0]), y) for x, y in zip(a, b, strict=True))
        most, late = self.known[0], join(self.known[1], (key, rows))
        self.known = [join(most, late), (key[:0], rows[:0])] if len(late[0]) > len(most[0]) // 8 else [most, late]

    def _learn(self, pieces: list[str], checks: np.ndarray) -> None:
        """Encode new pieces; their rows follow those in the table. Where no spans are asked for, the library's model gets
        the pieces as byte characters: they are cut already."""
        flat = lambda rows: np.fromiter(itertools.chain.from_iterable(rows), np.int32)
        if self.spans:
            found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
            ids = [e.ids for e in found]
            self._put("lo", self.n_ids, flat([a for a, _ in e.offsets] for e in found))
            self._put("hi", self.n_ids, flat([b for _, b in e.offsets] for e in found))
        else:
            cut = self.tokenizer.model.tokenize
            raw = [p.encode() for p in pieces]
            ends = np.cumsum([len(r) for r in raw]).tolist()
            chars = BYTE_CHARS[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-32-le")
            ids = [[t.id for t in cut(chars[a:b])] for a, b in zip([0, *ends], ends, strict=False)]
        self._put("checks", self.n, checks)
        self._put("at", self.n + 1, self.n_ids + np.cumsum([len(x) for x in ids]))
        self._put("ids", self.n_ids, flat(ids))
        self.n += len(ids)
        self.n_ids = int(self.at[self.n])

    def _whole(self, texts: list[str], spans: bool):
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        sizes = np.array([len(e.ids) for e in found], np.int64)
        flat = lambda rows: np.array([x for r in rows for x in r], np.int64)
        ids = flat(e.ids for e in found)
        if not spans:
            return ids, sizes, None, None
        return ids, sizes, flat([a for a, _ in e.offsets] for e in found), flat([b for _, b in e.offsets] for e in found)

    def encode(self, texts: list[str]):
        """Flat ids, the number of ids of each text, and if the encoder keeps spans the ids' first and end characters."""
        spans = self.spans
        if not texts:
            z = np.zeros(0, np.int64)
            return z, z, (z if spans else None), (z if spans else None)
        if not self.by_piece or any(a in t for a in self.added for t in texts):
            return self._whole(texts, spans)
        big = "".join(texts)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        cp = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(big, cp, bounds)
        if not len(starts):
            z = np.zeros(0, np.int64)
            return z, np.zeros(len(texts), np.int64), (z if spans else None), (z if spans else None)
        ends = np.append(starts[1:], len(big))
        # equal pieces share a row of the table: it is found by one hash, and a second one with the length confirms it
        value = cp + np.uint64(1)
        key = piece_hash(value, starts, ends, BASES[0])
        check = piece_hash(value, starts, ends, BASES[1]) + (ends - starts).astype(np.uint64)
        order = np.argsort(key)
        ordered = key[order]
        lead = np.append(True, ordered[1:] != ordered[:-1])
        same = np.empty(len(key), np.int64)
        same[order] = np.cumsum(lead) - 1
        one = order[lead]
        if (check != check[one][same]).any():
            return self._whole(texts, spans)
        rows = self._rows(key[one])
        found = rows >= 0
        if (self.checks[rows[found]] != check[one][found]).any():
            return self._whole(texts, spans)
        if not found.all():
            if self.n + int((~found).sum()) > TABLE_PIECES:
                self._reset()
                found[:] = False
            new = one[~found]
            rows[~found] = self.n + np.arange(len(new))
            self._learn([big[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], check[new])
            self._remember(key[new], rows[~found])
        # the ids of this slice's distinct pieces one after another, so that the many look-ups stay in a small array
        each = self.at[rows + 1] - self.at[rows]
        place = np.cumsum(each) - each
        held = np.arange(int(each.sum())) + np.repeat(self.at[rows] - place, each)
        size = each[same]
        end_at = np.cumsum(size)
        pick = np.arange(end_at[-1]) + np.repeat(place[same] - (end_at - size), size)
        counts = np.diff(np.append(0, end_at)[np.searchsorted(starts, bounds)])
        if not spans:
            return self.ids[held][pick], counts, None, None
        of_text = np.searchsorted(bounds, starts, "right") - 1
        base = np.repeat(starts - bounds[of_text], size)
        return self.ids[held][pick], counts, base + self.lo[held][pick], base + self.hi[held][pick]


@functools.lru_cache(2)
def encoder(path: str, spans: bool = False) -> PieceEncoder:
    """One encoder for each Python worker."""
    return PieceEncoder(path, spans)

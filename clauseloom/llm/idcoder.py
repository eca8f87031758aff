"""Adaptive coder for token ids: order-0 to order-2 predictions, mixed by adaptive weights, drive a range coder.

A block is reset on its own: it starts with an empty model and carries a checksum. Inside a block the ids are
cut into lanes that are coded in lockstep with numpy; all lanes share one model, which learns from every lane, so
that encoder and decoder see the same model. Each lane has its own range coder with 64-bit low and range, 32-bit
digits and carries.

For each id the model offers the id that followed the last two ids (order 2, a slot with a confidence), the counts of
the ids that followed the last id (order 1), and the counts of all ids (order 0). How much of the range each of the
three gets depends on counts kept for the order-2 confidence and the size of the order-1 row: this is the mix. Slots
learn after each step; mix and counts are taken anew after epochs, whose length grows with what has been seen (up to
``EPOCH_STEPS`` steps). All arithmetic is on integers, so the same bytes decode on any machine.

Block layout (little endian): the header ``HEADER`` below, the number of digits of each lane (u32 each), the digits
(u32 each, lane after lane). The checksum is a crc32 over all that follows it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CLM2"
#: magic, crc32 of the rest, number of ids, size of the alphabet, lanes, steps
HEADER = struct.Struct("<4sIQIII")
LANE_IDS, MAX_LANES = 512, 8192
#: Order-2 slots; a slot holds an id and, in the low 3 bits, its confidence.
ORDER2_BITS = 16
CONF = 7
EPOCH_STEPS = 64
#: Steps of an order-1 row's sizes in the mix, by powers of two.
SIZES = 12
#: The total at which the counts of a state of the mix are halved.
MIX_LIMIT = 1 << 16
#: Shares are parts of 2^bits: of the mix, and of an order-1 row. Rows with over half as many ids are not used.
MIX_BITS, ROW_BITS = 12, 16
BITS = MIX_BITS + ROW_BITS
#: Ids are below 2^ID_BITS: a pair of them and a place in an epoch fit in 63 bits.
ID_BITS = 22
U = np.uint64
LOW32, SHIFT32 = U(0xFFFFFFFF), U(32)
K1, K2 = np.uint32(2654435761), np.uint32(2246822519)


class CorruptBlock(ValueError):
    """The block's checksum or header does not fit its bytes."""


def search(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the sorted ``values`` are not over each x (below 2^44, 2^19 of them at most): the search is several
    times faster over sorted x, and a sort of x with its places in the low bits is cheap."""
    packed = np.sort((x << 19) | np.arange(len(x)))
    out = np.empty(len(x), np.int64)
    out[packed & ((1 << 19) - 1)] = np.searchsorted(values, packed >> 19, "right")
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct x (below 2^44, 2^19 of them at most) in order, how often each occurs, and the places of x in that
    order."""
    packed = np.sort((x << 19) | np.arange(len(x)))
    value = packed >> 19
    lead = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    return value[lead], np.diff(np.append(lead, len(x))), packed & ((1 << 19) - 1)


class Model:
    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.freq = np.ones(alphabet, np.int64)
        self.bits0 = min(31, max(20, alphabet.bit_length() + 6))
        #: pairs of ids (the first times the alphabet, plus the second), sorted, and how often they were seen
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.slots = np.zeros(1 << ORDER2_BITS, np.int32)
        self.mix = np.tile(np.array([2, 4, 1], np.int64), ((CONF + 1) * SIZES, 1))
        self.seen: list[np.ndarray] = []
        self.refresh()

    def refresh(self) -> None:
        """Shares of order 0 and 1 from the counts; each id that was seen (of order 0: each id) has one part at least."""
        shares = np.cumsum(self.mix, 1)
        shares = shares * ((1 << MIX_BITS) - 3) // shares[:, 2:] + np.arange(1, 4)
        self.edges = (np.pad(shares, ((0, 0), (1, 0))) << ROW_BITS).astype(U).ravel()
        total = np.cumsum(self.freq)
        room = (1 << self.bits0) - self.alphabet
        self.cum = np.append(0, total * room // total[-1] + np.arange(1, self.alphabet + 1)).astype(U)
        first, n = self.keys // self.alphabet, len(self.keys)
        lead = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, n))
        row = np.repeat(np.arange(len(lead)), size)
        total = np.cumsum(self.counts)
        before = total - self.counts
        base = before[lead]
        sums = np.append(before[lead[1:]], total[-1:]) - base
        at = np.arange(n) - lead[row]
        low = (before - base[row]) * ((1 << ROW_BITS) - size[row]) // sums[row] + at
        #: where each pair's share begins and ends (behind the last one: the whole), the same with the row's number above
        self.low, self.high = np.append(low, 0).astype(U), np.full(n + 1, 1 << ROW_BITS, U)
        inner = np.flatnonzero(at[1:] > 0)
        self.high[inner] = self.low[inner + 1]
        self.place = low + (row << ROW_BITS)
        self.second = (self.keys - first * self.alphabet).astype(np.int32)
        self.row = np.zeros(self.alphabet, np.int64)
        self.size = np.zeros(self.alphabet, np.int32)
        good = size <= 1 << (ROW_BITS - 1)
        self.row[first[lead]] = np.arange(len(lead))
        self.size[first[lead[good]]] = np.minimum(np.log2(sums[good] + 1).astype(np.int32), SIZES - 1)

    def locate(self, p1: np.ndarray, v: np.ndarray):
        """The distinct pairs (p1, v) of an epoch, how often each occurs, where each is or goes among the keys, which ones
        are there, and the places of the epoch in the order of their pairs."""
        new, n, places = runs(p1.astype(np.int64) * self.alphabet + v)
        at = np.searchsorted(self.keys, new)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == new[old]
        return new, n, at, old, places

    def find(self, located) -> np.ndarray:
        """The number of the pair at each place of a located epoch, or -1 if its row does not offer it."""
        new, n, at, old, places = located
        out = np.empty(len(places), np.int64)
        out[places] = np.repeat(np.where(old & (self.size[new // self.alphabet] > 0), at, -1), n)
        return out

    def predict(self, p1: np.ndarray, p2: np.ndarray):
        """Slots, their contents, the predicted ids, and the state of the mix."""
        h = ((p2.view(np.uint32) * K2) ^ (p1.view(np.uint32) * K1)) >> np.uint32(32 - ORDER2_BITS)
        held = self.slots[h]
        return h, held, held >> 3, (held & CONF) * SIZES + self.size[p1]

    def learn(self, v, h, held, hit, state, symbol) -> None:
        self.seen.append(state * 3 + symbol)
        conf = held & CONF
        self.slots[h] = np.where(hit, held + (conf < CONF), np.where(conf > 0, held - 1, (v << 3) | 1))

    def close_epoch(self, v: np.ndarray, located) -> None:
        """Count the ids v, the located pairs and the symbols of an epoch."""
        self.mix += np.bincount(np.concatenate(self.seen), minlength=self.mix.size).reshape(self.mix.shape)
        self.seen = []
        while (full := self.mix.sum(1) > MIX_LIMIT).any():
            self.mix[full] = (self.mix[full] >> 1) | 1
        self.freq += np.bincount(v, minlength=self.alphabet) * 24
        new, n, at, old, _ = located
        self.counts[at[old]] += n[old]
        self.keys = np.insert(self.keys, at[~old], new[~old])
        self.counts = np.insert(self.counts, at[~old], n[~old])
        self.refresh()


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    return -(-n // steps) if steps else 0, steps


def _epochs(steps: int, tail: int):
    """(start, stop) of the epochs; one ends where the last lane, which has ``tail`` ids, ends."""
    start = 0
    while start < steps:
        stop = min(steps, max(start + 1, min(start * 2, start + EPOCH_STEPS)))
        if start < tail < stop:
            stop = tail
        yield start, stop
        start = stop


def encode_block(ids: np.ndarray) -> bytes:
    """The block of these ids (non-negative, below 2^ID_BITS)."""
    ids = np.asarray(ids)
    n = len(ids)
    if n and (ids.min() < 0 or ids.max() >= 1 << ID_BITS):
        raise ValueError(f"ids lie in 0 to 2^{ID_BITS} - 1")
    alphabet = int(ids.max()) + 1 if n else 0
    lanes, steps = _lanes(n) if n else (0, 0)
    if not n:
        return _pack(b"", n, alphabet, lanes, steps)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    # two steps before the first one, as if ids were 0
    grid = np.concatenate([np.zeros((2, lanes), np.int32), grid.reshape(lanes, steps).T])
    tail = n - (lanes - 1) * steps
    m = Model(alphabet)
    low, rng = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    sent = np.zeros(lanes, np.int64)
    lanes_out, digits_out, carry_lane, carry_at = [], [], [], []

    def put(at, lo, hi, bits) -> None:
        """Code one symbol in the lanes ``at`` (a slice or indices): its share of 2^bits is [lo, hi)."""
        r = rng[at] >> U(bits)
        old = low[at]
        new = old + lo * r
        rg = (hi - lo) * r
        carry = np.flatnonzero(new < old)
        if len(carry):
            lane = carry if isinstance(at, slice) else at[carry]
            carry_lane.append(lane)
            carry_at.append(sent[lane] - 1)
        out = np.flatnonzero(rg <= LOW32)
        if len(out):
            lane = out if isinstance(at, slice) else at[out]
            lanes_out.append(lane.astype(np.int16))
            digits_out.append((new[out] >> SHIFT32).astype(np.uint32))
            sent[lane] += 1
            new[out] <<= SHIFT32
            rg[out] <<= SHIFT32
        low[at], rng[at] = new, rg

    for start, stop in _epochs(steps, tail):
        a = lanes if start < tail else lanes - 1
        before, now = grid[start + 1 : stop + 1, :a].ravel(), grid[start + 2 : stop + 2, :a].ravel()
        located = m.locate(before, now)
        every = m.find(located).reshape(-1, a)
        for t in range(start, stop):
            p2, p1, v, pair = grid[t, :a], grid[t + 1, :a], grid[t + 2, :a], every[t - start]
            h, held, q2, state = m.predict(p1, p2)
            hit = v == q2
            symbol = np.where(hit, 0, 2 - (pair >= 0))
            pair = np.where(hit, -1, pair)
            at, edges = state * 4 + symbol, m.edges
            begin = edges[at]
            width = (edges[at + 1] - begin) >> U(ROW_BITS)
            put(slice(0, a), begin + width * m.low[pair], begin + width * m.high[pair], BITS)
            sel = np.flatnonzero(symbol == 2)
            if len(sel):
                x = v[sel]
                put(sel, m.cum[x], m.cum[x + 1], m.bits0)
            m.learn(v, h, held, hit, state, symbol)
        m.close_epoch(now, located)
    lane = np.concatenate([*lanes_out, np.repeat(np.arange(lanes, dtype=np.int16), 2)])
    digit = np.concatenate([*digits_out, np.stack([low >> SHIFT32, low & LOW32], 1).ravel().astype(np.uint32)])
    digit = digit[np.argsort(lane, kind="stable")].astype(U)
    sizes = sent + 2
    if carry_lane:
        first = np.cumsum(sizes) - sizes
        np.add.at(digit, first[np.concatenate(carry_lane)] + np.concatenate(carry_at), U(1))
        while len(over := np.flatnonzero(digit > LOW32)):
            digit[over] &= LOW32
            np.add.at(digit, over - 1, U(1))
    return _pack(sizes.astype("<u4").tobytes() + digit.astype("<u4").tobytes(), n, alphabet, lanes, steps)


def _pack(body: bytes, n: int, alphabet: int, lanes: int, steps: int) -> bytes:
    rest = HEADER.pack(MAGIC, 0, n, alphabet, lanes, steps)[8:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; raises CorruptBlock if its bytes were changed or cut."""
    block = bytes(block)
    if len(block) < HEADER.size:
        raise CorruptBlock("shorter than its header")
    magic, crc, n, alphabet, lanes, steps = HEADER.unpack_from(block)
    if magic != MAGIC or crc != zlib.crc32(block[8:]):
        raise CorruptBlock("the checksum does not fit")
    if not n:
        return np.zeros(0, np.int32)
    sizes = np.frombuffer(block, "<u4", lanes, HEADER.size).astype(np.int64)
    digit = np.frombuffer(block, "<u4", offset=HEADER.size + 4 * lanes).astype(U)
    digit = np.append(digit, U(0))
    at = np.cumsum(sizes) - sizes
    value = (digit[at] << SHIFT32) | digit[at + 1]
    at += 2
    rng = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    m = Model(alphabet)
    grid = np.zeros((steps + 2, lanes), np.int32)
    tail = n - (lanes - 1) * steps

    def take(where, r, lo, hi) -> None:
        val = value[where] - lo * r
        rg = (hi - lo) * r
        out = np.flatnonzero(rg <= LOW32)
        if len(out):
            lane = out if isinstance(where, slice) else where[out]
            val[out] = (val[out] << SHIFT32) | digit[at[lane]]
            at[lane] += 1
            rg[out] <<= SHIFT32
        value[where], rng[where] = val, rg

    def part(sel, bits) -> tuple[np.ndarray, np.ndarray]:
        r = rng[sel] >> U(bits)
        return r, np.minimum(value[sel] // r, U((1 << bits) - 1))

    for start, stop in _epochs(steps, tail):
        a = lanes if start < tail else lanes - 1
        for t in range(start, stop):
            p2, p1 = grid[t, :a], grid[t + 1, :a]
            h, held, q2, state = m.predict(p1, p2)
            edges, four = m.edges, state * 4
            r, x = part(slice(0, a), BITS)
            symbol = (x >= edges[four + 1]).astype(np.int32) + (x >= edges[four + 2])
            four += symbol
            begin = edges[four]
            width = (edges[four + 1] - begin) >> U(ROW_BITS)
            v, pair = q2.copy(), np.full(a, -1)
            sel = np.flatnonzero(symbol == 1)
            if len(sel):
                inside = ((x[sel] - begin[sel]) // width[sel]).view(np.int64)
                y = search(m.place, (m.row[p1[sel]] << ROW_BITS) + inside) - 1
                pair[sel], v[sel] = y, m.second[y]
            take(slice(0, a), r, begin + width * m.low[pair], begin + width * m.high[pair])
            sel = np.flatnonzero(symbol == 2)
            if len(sel):
                r, x = part(sel, m.bits0)
                y = search(m.cum.view(np.int64), x.view(np.int64)) - 1
                take(sel, r, m.cum[y], m.cum[y + 1])
                v[sel] = y
            m.learn(v, h, held, v == q2, state, symbol)
            grid[t + 2, :a] = v
        now = grid[start + 2 : stop + 2, :a].ravel()
        m.close_epoch(now, m.locate(grid[start + 1 : stop + 1, :a].ravel(), now))
    return grid[2:].T.ravel()[:n]

"""An adaptive range coder for token ids, for many blocks side by side.

All blocks of a stripe are coded in step, one numpy lane each; every lane starts from the same
state and keeps its own, so a block can be decoded without any other. Before each id, order-2
and order-1 contexts (the last two ids, the last id) name the id that followed them last, each
with a count of how often it was right. The surer of both is the guess. Whether it is right is
coded with the mean of two adaptive probabilities, one kept by the order-2 count and whether both
agree, one by the order-1 count and the last outcomes. A wrong guess is followed by the high byte of the id,
as two 4-bit symbols from order-0 adaptive distributions (the second given the first), and by its
low byte, all values of which count as equally likely.

The range coder has 64 bits of state, gives out 16 at a time, and needs no carry: a range that
straddles two values is cut short.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SLOTS = 11  # bits
NONE = 0xFFFF
NODES = 1 + 16
FULL = 1 << 15  # of a distribution
_TOP, _LEAST, _WORD = np.uint64(48), np.uint64(1 << 32), np.uint64(16)
_STRADDLE = np.uint64(1 << 48)

# Where the bounds of a distribution move to after each symbol.
_TARGET = np.array(
    [[i if i <= s else FULL - 16 + i for i in range(17)] for s in range(16)], np.int32
)


@cache
def _first_bounds() -> np.ndarray:
    """Bounds of the 16 symbols at each node: small ids are likelier, as in most vocabularies."""
    mass = np.concatenate([[0.0], np.cumsum(1 / (np.arange(1 << 16) + 200.0))])
    rows = []
    for level in range(2):
        width = 1 << (4 * (3 - level))
        edges = mass[::width]
        for node in range(1 << (4 * level)):
            e = edges[16 * node : 16 * node + 17]
            share = (e - e[0]) / (e[16] - e[0])
            rows.append(np.floor(share * (FULL - 16)) + np.arange(17))
    return np.array(rows, np.int32)


class _Lanes:
    """The model's state in all lanes, and the steps that coding and decoding share."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        size = lanes << SLOTS
        self.base = (np.arange(lanes) << SLOTS).astype(np.int64)
        self.named = [np.full(size, NONE, np.uint16) for _ in range(2)]
        self.sure = [np.zeros(size, np.uint8) for _ in range(2)]
        self.bounds = np.tile(_first_bounds(), (lanes, 1))
        self.node0 = np.arange(lanes) * NODES
        self.odds = [np.full(lanes * 32, 1 << 14, np.int32), np.full(lanes * 64, 1 << 14, np.int32)]
        self.by = [np.arange(lanes) * 32, np.arange(lanes) * 64]
        self.last = np.zeros(lanes, np.int64)
        self.past = np.zeros(lanes, np.int64)
        self.luck = np.zeros(lanes, np.int64)
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, ~np.uint64(0))

    def guess(self) -> None:
        h2 = ((self.last * 40503 + self.past * 30011) >> 3) & ((1 << SLOTS) - 1)
        h1 = (self.last * 27449 >> 2) & ((1 << SLOTS) - 1)
        self.at = [self.base + h2, self.base + h1]
        n2, n1 = self.named[0][self.at[0]], self.named[1][self.at[1]]
        s2, s1 = self.sure[0][self.at[0]], self.sure[1][self.at[1]]
        self.names, self.counts = (n2, n1), (s2, s1)
        self.guessed = np.where((s2 >= s1) & (n2 != NONE), n2, n1)
        self.odds_at = (
            self.by[0] + s2 * 2 + (n2 == n1),
            self.by[1] + s1 * 4 + self.luck,
        )
        mean = (self.odds[0][self.odds_at[0]] + self.odds[1][self.odds_at[1]]) >> 1
        self.chance = np.clip(mean, 48, 65488).astype(np.uint64)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        for odds, at in zip(self.odds, self.odds_at, strict=True):
            old = odds[at]
            odds[at] = old + ((np.where(hit, 65535, 0) - old) >> 4)
        self.luck = ((self.luck << 1) | hit) & 3
        for named, sure, at, n, s in zip(
            self.named, self.sure, self.at, self.names, self.counts, strict=True
        ):
            right = n == ids
            named[at] = np.where(right | (s > 0), n, ids)
            sure[at] = np.where(right, np.minimum(s + 1, 15), s >> 1)
        self.past, self.last = self.last, ids.astype(np.int64)


def encode_lanes(ids: np.ndarray) -> list[bytes]:
    """One coded block for each row of ids (lanes, steps); ids are below 0xFFFF."""
    lanes, steps = ids.shape
    m = _Lanes(lanes)
    out = np.zeros((lanes, 4 * steps + 8), np.uint16)
    used = np.zeros(lanes, np.int64)

    def settled(low, rng, lane):
        while True:
            same = (low ^ (low + rng)) < _STRADDLE
            short = ~same & (rng < _LEAST)
            if short.any():
                rng[short] = (~low[short] + np.uint64(1)) & (_LEAST - np.uint64(1))
                same |= short
            at = np.flatnonzero(same)
            if not len(at):
                return
            own = lane[at]
            out[own, used[own]] = low[at] >> _TOP
            used[own] += 1
            low[at] <<= _WORD
            rng[at] <<= _WORD

    every = np.arange(lanes)
    columns = np.ascontiguousarray(ids.T.astype(np.uint16))
    for step in range(steps):
        now = columns[step]
        m.guess()
        hit = m.guessed == now
        cut = (m.range >> _WORD) * m.chance
        m.low += np.where(hit, np.uint64(0), cut)
        m.range = np.where(hit, cut, m.range - cut)
        settled(m.low, m.range, every)
        lane = np.flatnonzero(~hit)
        if len(lane):
            low, rng = m.low[lane], m.range[lane]
            missed = now[lane].astype(np.int64)
            first, path = m.node0[lane], np.zeros(len(lane), np.int64)
            offset = 0
            pick = np.arange(len(lane))
            for shift in (12, 8):
                row = first + offset + path
                symbol = (missed >> shift) & 15
                bounds = m.bounds[row]
                lo, hi = bounds[pick, symbol], bounds[pick, symbol + 1]
                unit = rng >> np.uint64(15)
                low += unit * lo.astype(np.uint64)
                rng = unit * (hi - lo).astype(np.uint64)
                settled(low, rng, lane)
                m.bounds[row] = bounds + ((_TARGET[symbol] - bounds) >> 5)
                offset, path = 1, symbol
            rng >>= np.uint64(8)
            low += rng * (missed & 255).astype(np.uint64)
            settled(low, rng, lane)
            m.low[lane], m.range[lane] = low, rng
        m.learn(now, hit)
    for _ in range(4):
        out[every, used] = m.low >> _TOP
        used += 1
        m.low <<= _WORD
    return [out[i, : used[i]].astype("<u2").tobytes() for i in range(lanes)]


def decode_lanes(blocks: list[bytes], steps: int) -> np.ndarray:
    """The ids (lanes, steps) of blocks from encode_lanes."""
    lanes = len(blocks)
    m = _Lanes(lanes)
    width = max((len(b) // 2 for b in blocks), default=0) + 8
    words = np.zeros((lanes, width), np.uint64)
    for i, b in enumerate(blocks):
        w = np.frombuffer(b, "<u2")
        words[i, : len(w)] = w
    used = np.full(lanes, 4)
    code = (words[:, 0] << _TOP) | (words[:, 1] << np.uint64(32)) | (words[:, 2] << _WORD) | words[:, 3]

    def settled(low, rng, code, lane):
        while True:
            same = (low ^ (low + rng)) < _STRADDLE
            short = ~same & (rng < _LEAST)
            if short.any():
                rng[short] = (~low[short] + np.uint64(1)) & (_LEAST - np.uint64(1))
                same |= short
            at = np.flatnonzero(same)
            if not len(at):
                return
            own = lane[at]
            code[at] = (code[at] << _WORD) | words[own, used[own]]
            used[own] += 1
            low[at] <<= _WORD
            rng[at] <<= _WORD

    every = np.arange(lanes)
    out = np.zeros((steps, lanes), np.uint16)
    for step in range(steps):
        m.guess()
        cut = (m.range >> _WORD) * m.chance
        hit = (code - m.low) < cut
        m.low += np.where(hit, np.uint64(0), cut)
        m.range = np.where(hit, cut, m.range - cut)
        settled(m.low, m.range, code, every)
        now = m.guessed.copy()
        lane = np.flatnonzero(~hit)
        if len(lane):
            low, rng, own = m.low[lane], m.range[lane], code[lane]
            first, path = m.node0[lane], np.zeros(len(lane), np.int64)
            missed = np.zeros(len(lane), np.int64)
            offset = 0
            pick = np.arange(len(lane))
            for shift in (12, 8):
                row = first + offset + path
                bounds = m.bounds[row]
                unit = rng >> np.uint64(15)
                value = np.minimum((own - low) // unit, np.uint64(FULL - 1)).astype(np.int32)
                symbol = (bounds <= value[:, None]).sum(axis=1) - 1
                lo, hi = bounds[pick, symbol], bounds[pick, symbol + 1]
                low += unit * lo.astype(np.uint64)
                rng = unit * (hi - lo).astype(np.uint64)
                settled(low, rng, own, lane)
                m.bounds[row] = bounds + ((_TARGET[symbol] - bounds) >> 5)
                offset, path = 1, symbol
                missed += symbol << shift
            rng >>= np.uint64(8)
            value = np.minimum((own - low) // rng, np.uint64(255))
            low += rng * value
            settled(low, rng, own, lane)
            missed += value.astype(np.int64)
            m.low[lane], m.range[lane], code[lane] = low, rng, own
            now[lane] = missed
        m.learn(now, hit)
        out[step] = now
    return np.ascontiguousarray(out.T)

"""Static range asymmetric numeral system over numpy arrays: interleaved lanes, one frequency table for many blocks.

A block deals its symbols round over ``LANES`` states of 64 bits (symbol i to lane i mod LANES) that share one
stream of 32-bit words; each step codes one symbol of each lane. A state stays in [2^31, 2^63). Coding runs backwards, so
decoding runs forwards. Every ``EVERY`` steps the states and the place in the stream are kept as a checkpoint: the
segments between checkpoints decode side by side, or one alone.
"""

from __future__ import annotations

import numpy as np

LANES, EVERY = 256, 128
_LOW, _WORD, _TOP = 1 << 31, np.uint64(32), 63


class Frequencies:
    """Frequencies of the symbols that occur, scaled so that they sum to a power of two and none is 0."""

    def __init__(self, symbols: np.ndarray, scaled: np.ndarray):
        self.symbols, self.scaled = symbols.astype("<u4"), scaled.astype("<u4")
        total = int(scaled.sum()) if len(scaled) else 1
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits or (len(scaled) and not scaled.all()):
            raise ValueError("frequencies must be above 0 and sum to a power of two")
        self._size = scaled.astype(np.uint64)
        self._from = np.cumsum(self._size) - self._size
        self._slots = None

    @classmethod
    def of(cls, symbols: np.ndarray) -> "Frequencies":
        counts = np.bincount(symbols)
        found = np.flatnonzero(counts)
        room = 1 << max(14, len(found).bit_length() + 3)
        total = max(1, len(symbols))
        scaled = [1 + int(c) * (room - len(found)) // total for c in counts[found]]
        if scaled:
            scaled[int(np.argmax(counts[found]))] += room - sum(scaled)
        return cls(found, np.array(scaled, dtype=np.int64))

    def coded(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and start of each symbol's range."""
        at = np.zeros(int(self.symbols[-1]) + 1, dtype=np.int64)
        at[self.symbols] = np.arange(len(self.symbols))
        at = at[symbols]
        return self._size[at], self._from[at]

    @property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each slot its symbol, and the symbol's frequency (high half) with the slot's place among the symbol's (low half)."""
        if self._slots is None:
            place = np.arange(1 << self.bits, dtype=np.uint64) - np.repeat(self._from, self.scaled)
            self._slots = np.repeat(self.symbols, self.scaled), (np.repeat(self._size, self.scaled) << _WORD) | place
        return self._slots


def encode(blocks: np.ndarray, table: Frequencies, lanes: int = LANES, every: int = EVERY) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(states of each checkpoint, place in the words of each checkpoint, words) of each row of blocks, which are coded side by side; a row has at least one symbol and there are at most 256 rows."""
    many, n = blocks.shape
    steps = -(-n // lanes)
    full = np.concatenate([blocks, np.repeat(blocks[:, :1], steps * lanes - n, axis=1)], axis=1).reshape(many, steps, lanes).transpose(1, 0, 2)
    size, start = table.coded(full)
    bits, most = np.uint64(table.bits), size << np.uint64(_TOP - table.bits)
    size_left = (np.uint64(1) << bits) - size
    x = np.full((many, lanes), _LOW, dtype=np.uint64)
    words, counts, states = [], np.zeros((steps, many), dtype=np.int64), []
    for step in range(steps - 1, -1, -1):
        width = min(lanes, n - step * lanes)
        now = x if width == lanes else x[:, :width]
        high = now >= most[step, :, :width]
        if (out := now[high]).size:
            words.append(out.astype(np.uint32))  # the low half
            counts[step] = high.sum(axis=1)
            now[high] = out >> _WORD
        q = now // size[step, :, :width]
        q *= size_left[step, :, :width]
        now += q
        now += start[step, :, :width]
        if step % every == 0:
            states.append(x.copy())
    words = np.concatenate([*words[::-1], np.empty(0, np.uint32)]).astype("<u4")
    owner = np.repeat(np.tile(np.arange(many, dtype=np.uint8), steps), counts.reshape(-1))
    words = np.split(words[np.argsort(owner, kind="stable")], np.cumsum(counts.sum(axis=0))[:-1])
    places = (np.cumsum(counts, axis=0) - counts)[::every].astype("<u4")
    return [(np.array([s[k] for s in states[::-1]]), places[:, k], words[k]) for k in range(many)]


def decode(n: int, table: Frequencies, states: np.ndarray, places: np.ndarray, words: np.ndarray, every: int = EVERY, first: int = 0, last: int | None = None) -> np.ndarray:
    """The symbols of the segments first to last (not included) of a block of n symbols, all segments side by side."""
    lanes = states.shape[1]
    steps, last = -(-n // lanes), len(states) if last is None else last
    mask, bits, low_half = np.uint64((1 << table.bits) - 1), np.uint64(table.bits), np.uint64(0xFFFFFFFF)
    words, (symbols, both) = words.astype(np.uint64), table.slots
    x, at = states[first:last].astype(np.uint64), places[first:last].astype(np.int64)
    ends = last == len(states)
    slots = np.zeros((last - first, every, lanes), dtype=np.uint32)
    for j in range(every):
        rows = last - first - int(ends and (last - 1) * every + j >= steps)
        if not rows:
            break
        now = x[:rows]
        slot = (now & mask).astype(np.int64)
        slots[:rows, j] = slot
        found = both.take(slot)
        made = found >> _WORD
        made *= now >> bits
        found &= low_half
        made += found
        if ends and rows == last - first and (last - 1) * every + j == steps - 1 and n % lanes:
            made[-1, n % lanes :] = now[-1, n % lanes :]
        low = made < _LOW
        counts = low.sum(axis=1)
        if total := int(counts.sum()):
            # Each row's lanes read on where the row has come to.
            source = np.repeat(at[:rows] - np.cumsum(counts) + counts, counts) + np.arange(total)
            made[low] = (made[low] << _WORD) | words[source]
            at[:rows] += counts
        x[:rows] = made
    if ends and (x[-1] != _LOW).any():
        raise ValueError("a block doesn't end in the state it was begun with")
    return symbols[slots.reshape(-1)[: min(n, last * every * lanes) - first * every * lanes]]

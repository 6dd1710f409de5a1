"""Words of many texts at a time, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A byte's factor is by its place in the word, counted modulo this.
_SPAN = 1 << 12
_POWERS = np.cumprod(np.full(_SPAN, _BASE, np.uint64), dtype=np.uint64)
#: Lower case for A-Z, and every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with ASCII other than letters as white space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Table:
    """Numbers, none below 0, by distinct 64-bit keys, looked up many at a time: open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        keys, values = keys.view(np.uint64), np.asarray(values, np.int32)
        spot = self._spot(keys)
        while len(keys):
            free = self.values[spot] < 0
            self.keys[spot[free]] = keys[free]  # of several keys one stays
            self.values[spot[free]] = 0
            there = free & (self.keys[spot] == keys)
            self.values[spot[there]] = values[there]
            keys, values, spot = keys[~there], values[~there], (spot[~there] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def of(cls, found: dict[int, int]) -> Table:
        return cls(np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found)))

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        keys = keys.view(np.uint64)
        spot = self._spot(keys)
        out, same = self.values[spot], self.keys[spot] == keys
        on = np.flatnonzero(~same & (out >= 0))
        while len(on):
            spot[on] = (spot[on] + 1) & ((1 << self.bits) - 1)
            held = self.values[spot[on]]
            out[on] = held
            on = on[(held >= 0) & (self.keys[spot[on]] != keys[on])]
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def leading(texts: Sequence[bytes], table: bytes = LOWER) -> np.ndarray:
    """The first byte of each of the words that hashes() gives."""
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(table), np.uint8)
    first = ~_SPACE[data]
    first[1:] &= _SPACE[data[:-1]]
    return data[first]


def hashes(texts: Sequence[bytes], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the hashes of all words, those of text i at offsets[i] to offsets[i + 1].  table translates bytes first."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer((b"\n".join(texts) + b"\n").translate(table), np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    reach = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, reach)
    with np.errstate(over="ignore"):
        summed = np.add.reduceat(_BYTE[data[starts[0] :]] * _POWERS[place & (_SPAN - 1)], starts - starts[0])
    return mix(summed), offsets


def groups(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, in lists of about ``most`` bytes; a longer text is alone or last in its list."""
    held, size = [], 0
    for text in texts:
        data = text.encode("utf-8") if text else b""
        held.append(data)
        size += len(data)
        if size >= most or len(held) >= 1024:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): hashes of every n words in a row within a text; a text of fewer words but one has all as one."""
    with np.errstate(over="ignore"):
        size = np.diff(offsets)
        count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
        out_offsets = np.concatenate([[0], np.cumsum(count)])
        total = int(out_offsets[-1])
        at = np.arange(total) - np.repeat(out_offsets[:-1], count) + np.repeat(offsets[:-1], count)
        length = np.repeat(np.minimum(size, n), count)
        out = np.zeros(total, np.uint64)
        for j in range(n):
            there = length > j
            if there.all():
                out = mix(out + words[at + j] * np.uint64(2 * j + 3))
            else:
                out[there] = mix(out[there] + words[at[there] + j] * np.uint64(2 * j + 3))
    return out, out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and once each."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(len(offsets)))

"""Polynomial hashes over numpy arrays: every window of a sequence by two prefix sums, modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
#: A random odd number for each byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 16)
        ones = np.ones(n, np.uint64)
        ones[1:] = np.uint64(_BASE)
        _powers = np.multiply.accumulate(ones)
        ones[1:] = np.uint64(_INVERSE)
        _inverses = np.multiply.accumulate(ones)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefixes:
    """Hashes of symbols[start : start + length] for arrays of starts and lengths."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        _grown(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers[:n], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _inverses[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(self.raw(starts, ends) + (ends - starts).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """The hash of each window of that length."""
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length:] - self.sums[:n]) * _inverses[:n] + np.uint64(length))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of rows that fill data; no word goes over a row's end."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=word[1:-1])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | first))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    return starts, ends


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows of data between offsets, and the offsets of the rows among them."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if lower:
        data = lowered(data)
    starts, ends = word_spans(data, offsets)
    return Prefixes(BYTE_VALUES[data]).hashes(starts, ends), np.searchsorted(starts, offsets)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def super_runs(symbols: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Super-k-mers: the longest runs of windows that share their minimizer, which is the least hash of `anchor`
    symbols in the window. row: of the sequence; start: of the first window; n: windows; at: the minimizer's place
    from start; mh: its hash; sh: hash of all symbols under the run. Equal windows, wherever they stand, have equal mh."""
    n = len(symbols)
    if n < window:
        return {k: np.zeros(0, t) for k, t in (("row", np.int64), ("start", np.int64), ("n", np.int64), ("at", np.int64), ("mh", np.int64), ("sh", np.int64))}
    prefixes = Prefixes(symbols)
    least = prefixes.every(anchor)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((least & ~low) | np.arange(len(least), dtype=np.uint64), window - anchor + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    valid = np.zeros(len(least) + 2, bool)
    np.less_equal(np.arange(window, window + len(least)), ends, out=valid[1:-1])
    change = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    starts = np.flatnonzero(valid[1:-1] & (~valid[:-2] | change[:-1]))
    lasts = np.flatnonzero(valid[1:-1] & (~valid[2:] | change[1:]))
    at = (least[starts] & low).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    return {
        "row": row,
        "start": starts - offsets[row],
        "n": lasts - starts + 1,
        "at": at - starts,
        "mh": prefixes.hashes(at, at + anchor).view(np.int64),
        "sh": prefixes.hashes(starts, lasts + window).view(np.int64),
    }

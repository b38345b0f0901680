"""Words of whole Arrow text columns, hashed with numpy for all documents at once.

A word's hash is a polynomial over its bytes, taken from a running sum over the
text, then mixed: modulo 2**64 where hashes only spread words (``WordHasher``),
modulo two primes together where they stand for words (``PrimeHasher``), as the
powers of two have words of one hash by construction.  A column is worked
through in runs of about ``CHUNK`` bytes, so memory does not grow with the
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers of the base and of its inverse, grown when a longer run comes."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def fit(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = powers(n, _BASE), powers(n, _INVERSE)


def is_space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents that together hold about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words before each document."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~space[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


class WordHasher:
    """Per-run word hashes; ``fold`` lower-cases A-Z first."""

    def __init__(self, fold: bool = True) -> None:
        self.tables, self.space, self.fold = _Tables(), is_space_table(), lower_table() if fold else None

    def words(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, word hashes, word offsets of these rows)."""
        raw, offsets = utf8_parts(column)
        for a, b in runs(offsets):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, firsts = word_spans(part, at, self.space)
            if self.fold is not None:
                part = self.fold[part]
            yield a, b, self.of(part, starts, ends), firsts

    def of(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words at ``starts`` to ``ends`` of a run of bytes."""
        self.tables.fit(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.tables.up[: len(part)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.tables.down[starts])


class PrimeHasher(WordHasher):
    """Word hashes by two polynomials modulo primes, 62 bits, with the word's length."""

    PRIMES = (2**31 - 1, 2**31 - 19)
    BASES = (1_103_515_245, 1_664_525_017)
    #: Bytes whose products may be added up without a remainder.
    SHORT = 1 << 24

    def __init__(self, fold: bool = True) -> None:
        super().__init__(fold)
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in self.PRIMES]

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        prime = np.uint64(self.PRIMES[which])
        if n > len(self.powers[which][0]):
            grown = []
            for known, base in zip(self.powers[which], (self.BASES[which], pow(self.BASES[which], -1, int(prime))), strict=True):
                while len(known) < n:
                    known = np.concatenate([known, known * np.uint64(pow(base, len(known), int(prime))) % prime])
                grown.append(known)
            self.powers[which] = tuple(grown)
        return self.powers[which]

    def of(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), dtype=np.uint64)
        for which, p in enumerate(self.PRIMES):
            prime = np.uint64(p)
            up, down = self._powers(which, len(part) + 1)
            terms = (part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]
            if len(part) > self.SHORT:
                terms %= prime
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(terms, out=total[1:])
            out = out << np.uint64(31) | (total[ends] - total[starts]) % prime * down[starts] % prime
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and the shingles before each document.

    A document of 1 to ``k - 1`` words gives its whole sequence as one shingle.
    """
    counts = np.diff(firsts)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n_out)])
    out = np.zeros(int(out_first[-1]), dtype=np.uint64)
    whole = counts >= k
    if whole.any():
        rows = np.repeat(np.flatnonzero(whole), n_out[whole])
        at = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(n_out[whole])[:-1]]), n_out[whole])
        src = firsts[rows] + at
        h = np.full(len(src), k, dtype=np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(_BASE) + words[src + j])
        out[out_first[rows] + at] = h
    for row in np.flatnonzero(~whole & (counts > 0)):
        h = np.array([counts[row]], dtype=np.uint64)
        for j in range(firsts[row], firsts[row + 1]):
            h = mix(h * np.uint64(_BASE) + words[j : j + 1])
        out[out_first[row]] = h[0]
    return out, out_first

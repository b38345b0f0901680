"""Content-defined buckets for all substrings of a fixed length.

Every ``length``-byte string holds ``length - GRAM + 1`` overlapping grams;
the one with the least hash (leftmost on ties) is its anchor.  Equal strings
have equal anchors at equal places, so strings can only be equal inside one
anchor's bucket.  Neighbouring strings mostly share their anchor: one row
stands for such a run of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestar.llm.wordhash import _Tables, mix, runs, utf8_parts

GRAM = 32
#: Bytes of text at once; eight for each must fit a core's cache.
CHUNK = 1 << 17


class Anchorer:
    def __init__(self, length: int) -> None:
        self.length, self.tables = length, _Tables()

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
        """(first row, last row, runs of strings of these rows).

        A run has: row (from the first row on), lo and hi (its strings' first
        and last start in the document), anchor (place of the gram) and bucket
        (hash of the gram).
        """
        raw_all, offsets_all = utf8_parts(column)
        for a, b in runs(offsets_all, CHUNK):
            raw, offsets = raw_all[offsets_all[a] : offsets_all[b]], offsets_all[a : b + 1] - offsets_all[a]
            yield a, b, self.of(raw, offsets)

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        n, length = len(raw), self.length
        if n < length:
            return {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "anchor", "bucket")}
        self.tables.fit(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.tables.up[:n], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * self.tables.down[: n - GRAM + 1])
        key = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        span, width = 1, length - GRAM + 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
        # key[p] is the least gram of the string that starts at p
        lengths = np.diff(offsets)
        counts = np.maximum(lengths - length + 1, 0)
        rows = np.repeat(np.arange(len(lengths)), counts)
        starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[rows]
        place = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(place):
            return {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "anchor", "bucket")}
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        lo, hi, anchor, row = starts[first], starts[last], place[first], rows[first]
        base = offsets[row]
        return {"row": row, "lo": lo - base, "hi": hi - base, "anchor": anchor - base, "bucket": grams[anchor].view(np.int64)}

"""Hierarchical packing of token sequences into windows of several lengths.

Every document is cut into full long windows; what is left is routed to the
smallest tier that holds it.  Long remainders open windows of their tier and
the gaps are filled from shorter tiers, cutting freely, so that every window
is full.  At the end of a partition the last tokens are cut into windows
whose lengths are powers of two.  Windows are dealt to step groups of equal
token counts, the fullest open group that still has room first.

All of this happens inside the partition that read the documents: no shuffle,
memory bounded by one batch and the open pools, and a lost task repeats
with the same result because its number is part of every sequence id.

Defined results: a null or empty text is its end token alone; an added token's
string in a text is that token; very long texts become many full windows;
equal texts and repeated rows are packed each on their own; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.wordhash import runs, utf8_parts

WINDOW = 1024
TIERS = (256, 512, 1024)
STEP_TOKENS = 8 * WINDOW
RESERVE = 8 * WINDOW
#: Bytes of text that are encoded at once.
RUN_BYTES = 8 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_id long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a text column, from the JSON tokenizer.

    Byte-level BPE never joins over a single blank between two other
    characters, so texts are cut there and every distinct cut is looked up
    once.  Cuts not met before go through the tokenizer ``AT_ONCE`` in a joined text;
    the bytes that each id stands for say where one cut ends.  The ``KNOWN``
    cuts met most often, with older meetings counting half as much at every
    run of texts, are kept with their ids as Arrow columns.
    """

    KNOWN, LONGEST, AT_ONCE = 1 << 18, 64, 1 << 15

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a cut goes through once, so the tokenizer's own table of words would only cost time
        self.tokenizer.model._resize_cache(0)
        self.cuts, self.parts, self.met = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # in the vocabulary one character stands for one byte
        self.n_bytes = np.array([added.get(i) or len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], dtype=np.int64)

    def ids(self, text: str) -> bytes:
        # the fast form leaves out offsets, which nothing here reads
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def learn(self, cuts: pa.Array) -> pa.Array:
        """The ids of each of ``cuts`` after a blank, from the tokenizer."""
        whole = pc.binary_join(pa.LargeListArray.from_arrays([0, len(cuts)], cuts), " ")[0].as_py()
        raw = self.ids(" " + whole)
        ends = np.cumsum(pc.binary_length(cuts).to_numpy().astype(np.int64) + 1)
        n_ids = np.searchsorted(np.cumsum(self.n_bytes[np.frombuffer(raw, "<u4")]), ends) + 1
        bounds = np.concatenate([[0], 4 * n_ids]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])

    def after_blank(self, cuts: pa.Array, times: np.ndarray) -> pa.Array:
        """The ids of each of the distinct ``cuts`` after a blank; ``times`` is how often each was met."""
        known = self.cuts.cast(cuts.type)
        place = pc.index_in(cuts, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
        missing = place < 0
        new = cuts.filter(pa.array(missing))
        place[missing] = len(known) + np.arange(len(new))
        learned = [self.learn(new.slice(i, self.AT_ONCE)) for i in range(0, len(new), self.AT_ONCE)]
        known, parts = pa.concat_arrays([known, new]), pa.concat_arrays([self.parts, *learned])
        met = np.concatenate([self.met // 2, np.zeros(len(new), np.int64)])
        met[place] += times
        keep = np.flatnonzero(pc.binary_length(known).to_numpy() <= self.LONGEST)
        if len(keep) > self.KNOWN:
            keep = keep[np.argpartition(-met[keep], self.KNOWN)[: self.KNOWN]]
        self.cuts, self.parts, self.met = known.take(pa.array(keep)), parts.take(pa.array(keep)), met[keep]
        return parts.take(pa.array(place))

    def many(self, column: pa.Array) -> tuple[bytes, np.ndarray]:
        """(little-endian ids of all texts, the bytes before each text)."""
        if not len(column):
            return b"", np.zeros(1, np.int64)
        lists = pc.split_pattern(column.fill_null(""), " ")
        at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        cuts, code = coded.dictionary, coded.indices.to_numpy()
        # white space at a cut's edge may be one token with the blank beside it
        size = pc.binary_length(cuts).to_numpy()
        begins, ends = ((size == 0) | (pc.binary_length(trim(cuts)).to_numpy() < size) for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        loose = ends[code[:-1]] | begins[code[1:]]
        loose[at[1:-1] - 1] = False  # from one text to the next there is no blank
        joined = np.zeros(len(column), dtype=bool)
        joined[np.searchsorted(at, np.flatnonzero(loose), side="right") - 1] = True
        first = np.zeros(len(code), dtype=bool)
        first[at[:-1]] = True
        # texts with such cuts, and the first cut of every text, are encoded as they are
        inner = ~first & ~np.repeat(joined, np.diff(at))
        times = np.bincount(code[inner], minlength=len(cuts))
        used = np.flatnonzero(times)
        parts = self.after_blank(cuts.take(pa.array(used)), times[used])
        place = np.zeros(len(cuts), dtype=np.int64)
        place[used] = np.arange(len(used))
        which = np.full(len(code), -1, dtype=np.int64)
        which[inner] = place[code[inner]]
        which[at[:-1]] = len(parts) + np.arange(len(column))
        alone = pa.array([self.ids(x) for x in self._alone(column, cuts, code, at, joined)], pa.large_binary())
        there = which >= 0
        whole = pa.concat_arrays([parts, alone]).take(pa.array(which[there]))
        _, bounds, raw = whole.buffers()
        bounds = np.frombuffer(bounds, np.int64)[: len(whole) + 1]
        return raw.to_pybytes()[: bounds[-1]] if raw else b"", bounds[np.concatenate([[0], np.cumsum(there)])[at]]

    @staticmethod
    def _alone(column: pa.Array, cuts: pa.Array, code: np.ndarray, at: np.ndarray, joined: np.ndarray) -> Iterator[str]:
        for row, whole in enumerate(joined.tolist()):
            yield (column[row] if whole else cuts[int(code[at[row]])]).as_py()


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker.

    Functions reach a worker by value, so it is kept in a module of the
    worker's own and not in a variable here.
    """
    shared = sys.modules.setdefault("_lodestar_worker", types.ModuleType("_lodestar_worker")).__dict__
    if path not in shared:
        shared[path] = Encoder(path)
    return shared[path]


def returned() -> None:
    """Gives memory that is free in this worker back to the machine: workers stay between stages, and their neighbours need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


class Packer:
    """Pools of remainders by tier; ``emit`` takes (piece, sequence, offset, window, step)."""

    def __init__(self, first_id: int, emit: Callable) -> None:
        self.emit, self.next_sequence, self.next_step = emit, first_id, first_id
        self.pools: dict[int, deque] = {tier: deque() for tier in TIERS}
        self.pooled = 0
        self.steps: dict[int, int] = {}

    def add(self, doc: tuple, tokens: int) -> None:
        full = tokens // WINDOW * WINDOW
        for start in range(0, full, WINDOW):
            self.window(WINDOW, [(doc, start, WINDOW)])
        if full < tokens:
            self.route(doc, full, tokens - full)

    def route(self, doc: tuple, start: int, length: int) -> None:
        self.pools[next(t for t in TIERS if length <= t)].append((doc, start, length))
        self.pooled += length

    def window(self, size: int, pieces: list[tuple]) -> None:
        sequence, offset = self.next_sequence, 0
        self.next_sequence += 1
        step = self.step_for(size)
        for doc, start, length in pieces:
            self.emit(doc, start, length, sequence, offset, size, step)
            offset += length

    def step_for(self, size: int) -> int:
        step = min((s for s, room in self.steps.items() if room >= size), key=lambda s: (self.steps[s], s), default=None)
        if step is None:
            step, self.next_step = self.next_step, self.next_step + 1
            self.steps[step] = STEP_TOKENS
        self.steps[step] -= size
        if not self.steps[step]:
            del self.steps[step]
        return step

    def take(self, most: int) -> tuple:
        """A piece of at most ``most`` tokens: from the longest tier below that, else cut."""
        fits = [t for t in TIERS if t <= most and self.pools[t]]
        tier = fits[-1] if fits else next(t for t in TIERS if self.pools[t])
        doc, start, length = self.pools[tier].popleft()
        self.pooled -= length
        if length > most:
            self.route(doc, start + most, length - most)
            length = most
        return doc, start, length

    def fill(self, size: int, pieces: list[tuple]) -> None:
        room = size - sum(p[2] for p in pieces)
        while room:
            pieces.append(self.take(room))
            room -= pieces[-1][2]
        self.window(size, pieces)

    def pack(self, reserve: int) -> None:
        while self.pooled >= max(reserve, WINDOW):
            tier = next(t for t in reversed(TIERS) if self.pools[t])
            piece = self.pools[tier].popleft()
            self.pooled -= piece[2]
            self.fill(tier, [piece])

    def finish(self) -> None:
        self.pack(0)
        size = WINDOW
        while self.pooled:
            while size > self.pooled:
                size //= 2
            self.fill(size, [])


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece of a document's ids (its end id included)."""
    path, end = tokenizer_path or default_tokenizer(), np.array([end_id], dtype="<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        rows: list[tuple] = []

        def emit(doc: tuple, start: int, length: int, *place: int) -> None:
            doc_id, ids, tokens = doc
            rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens, *place))

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            rows.clear()
            return out

        packer = Packer(TaskContext.get().partitionId() << 40, emit)
        for batch in batches:
            offsets, doc_ids = utf8_parts(batch.column("text"))[1], batch.column("doc_id").to_pylist()
            for first, last in runs(offsets, RUN_BYTES):
                ids, at = encode.many(batch.column("text").slice(first, last - first))
                for doc_id, a, b in zip(doc_ids[first:last], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    tokens = (b - a) // 4 + 1
                    packer.add((doc_id, ids[a:b] + end, tokens), tokens)
                    packer.pack(RESERVE)
                    if len(rows) >= 20_000:
                        yield flush()
        packer.finish()
        yield flush()
        returned()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)

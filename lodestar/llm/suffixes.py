"""Blockwise suffix sorting with a difference cover, and repeated-substring removal.

Removes every byte that lies in a ``LENGTH``-byte string which starts
anywhere else too, in the same document or another.

Bucketing.  A string's bucket is its anchor (see ``anchors``); a run of
neighbouring strings with one anchor is one row.  Buckets of one row hold no
repeat.  All other runs are cut into slices of at most ``SLICE`` neighbouring
strings, and a slice's suffix bucket is the bytes that all strings of its
place have in common.  Slices are named by 128 bits of BLAKE2b over their bytes
and counted by name, so a large group of copies is one row; the bytes of one
slice of each name are cut out where a suffix bucket has two slices or more.

Sorting.  Every suffix bucket is sorted, and the sort alone says which strings
are equal: hashes only deal rows to buckets and name them.  A task works
through its buckets in blocks of about ``BLOCK_BYTES``: the suffixes of a block
are sorted by their first ``PERIOD`` bytes, and longer ties are resolved by
ranks that were computed before for the block's difference-cover sample.  A
bucket over ``WIDE_BYTES`` is dealt anew by all bytes of its strings, one
string a row, copies counted, and is sorted likewise.

Defined results: null text is empty; texts under ``LENGTH`` bytes lose
nothing; texts are worked on whole; ties, equal texts and repeated rows are
repeats of each other; rows are named by their texts, so equal texts are cut
once, counted, and get equal results; an empty table gives no rows; further
columns stay in ``remove_repeats``, are ignored by ``repeat_table``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm.anchors import Anchorer
from lodestar.llm.scratch import dropped, stored
from lodestar.llm.wordhash import utf8_parts

LENGTH = 200
PERIOD = 32
RANKED = 4 * PERIOD
SLICE = 43
BLOCK_BYTES = 1 << 20
#: A suffix bucket over so many bytes is dealt by all bytes of its strings.
WIDE_BYTES = BLOCK_BYTES
KEY = "text_key"


def difference_cover(period: int) -> np.ndarray:
    """A small set of residues whose differences give every residue (greedy)."""
    cover, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        gains = {c: {(c - x) % period for x in cover} | {(x - c) % period for x in cover} for c in range(period) if c not in cover}
        best = max(sorted(gains), key=lambda c: len(gains[c] & missing))
        cover.append(best)
        missing -= gains[best]
    return np.array(sorted(cover))


def _big_endian(text: np.ndarray, at: np.ndarray, n: int = PERIOD) -> list[np.ndarray]:
    """``n`` bytes or a few more from each place as whole numbers that sort like the bytes."""
    return [np.ascontiguousarray(text[at[:, None] + np.arange(k, k + 8)]).view(">u8").ravel().astype(np.uint64) for k in range(0, n, 8)]


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``key``, and the classes of equal values in that order."""
    order = np.argsort(key)
    key = key[order]
    return order, np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])[: len(key)])


def _pair_order(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for two columns of ranks from -1: with the row number in the low bits a plain sort will do, where all fit one number."""
    bits, low, high = (int(n).bit_length() for n in (len(one), two.max(initial=0) + 1, one.max(initial=0) + 1))
    if bits + low + high > 63:
        return _order(_ranks(*_order(one)) * (int(two.max(initial=0)) + 2) + two + 1)
    packed = np.sort((one + 1) << (low + bits) | (two + 1) << bits | np.arange(len(one)))
    both = packed >> bits
    return packed & ((1 << bits) - 1), np.cumsum(np.concatenate([[False], both[1:] != both[:-1]])[: len(both)])


def _ranks(order: np.ndarray, classes: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = classes
    return ranks


def _sorted_keys(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by ``keys``, whose words (unsigned) become ranks first, and the classes of equal rows in that order."""
    out = _order(keys[0])
    for key in keys[1:]:
        out = _pair_order(_ranks(*out), _ranks(*_order(key)) if key.dtype == np.uint64 else key)
    return out


def cover_ranks(text: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """For each sampled place, the rank of its next ``RANKED`` bytes in the block, else -1.

    By doubling: places of one residue follow each other a period apart.
    """
    n = len(text) - PERIOD
    places = np.concatenate([np.arange(r, n, PERIOD) for r in cover])
    ranks = np.full(len(text) + RANKED, -1, dtype=np.int64)
    ranks[places] = _ranks(*_sorted_keys(_big_endian(text, places)))
    step = PERIOD
    while step < RANKED:
        ranks[places] = _ranks(*_pair_order(ranks[places], ranks[places + step]))
        step *= 2
    return ranks


def block_classes(text: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings at ``starts`` inside ``groups``, and their classes in that order.

    Strings of one group start at one residue of ``PERIOD``, so a group has
    one offset to its first sampled place, and one to the last whose rank ends
    with the string or before.
    """
    cover = difference_cover(PERIOD)
    ranks = cover_ranks(text, cover)
    ahead, behind = (np.array([min(way * (c - r) % PERIOD for c in cover) for r in range(PERIOD)]) for way in (1, -1))
    first, rest = ahead[starts % PERIOD], behind[(starts + length - RANKED) % PERIOD]
    # bytes before the first rank and after the last one
    n_head, n_tail = int(first.max(initial=0)), int(rest.max(initial=0))
    head, tail = _big_endian(text, starts, n_head), _big_endian(text, starts + length - -(-n_tail // 8) * 8, n_tail)
    return _sorted_keys([groups, *head, ranks[starts + first], ranks[starts + length - RANKED - rest], *tail])


def _anchored(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchorer, names = Anchorer(LENGTH), ["lo", "hi", "anchor"]
        for batch in batches:
            for a, _, run in anchorer.runs(batch.column("text")):
                keys = batch.column(KEY).take(pa.array(run["row"] + a))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(run[c].astype(np.int32)) for c in names), pa.array(run["bucket"])], names=[KEY, *names, "bucket"])

    return docs.mapInArrow(read, f"{KEY} binary, lo int, hi int, anchor int, bucket long")


def _text_key(text: Column) -> Column:
    """128 bits of SHA-256: rows of one text lose the same bytes."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)), 1, 16)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_text_key(F.col("text")).alias(KEY), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _each_once(texts: DataFrame) -> DataFrame:
    return texts.groupBy(KEY).agg(F.any_value("text").alias("text"), F.count("*").alias("times"))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(the row of each entry, the entries) of a column of lists of structs, null lists empty."""
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy()), column.flatten()


def _slices(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Every run in slices of up to ``SLICE`` strings, each text once; ``copies`` is how many rows have the text.

    ``piece`` names a slice's bytes and ``before``, the bytes from its start to
    the anchor.
    """
    schema = f"suffix_bucket long, piece binary, {KEY} binary, start int, before int, size int, copies long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            whole = memoryview(raw)
            row, runs = _flat(batch.column("runs"))
            lo, hi, x = (runs.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "anchor"))
            names = runs.field("bucket").to_numpy().view(np.uint64)
            least = (x - hi) // SLICE
            n = (x - lo) // SLICE - least + 1
            run = np.repeat(np.arange(len(n)), n)
            k = least[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            row, x = row[run], x[run]
            near, far = k * SLICE, k * SLICE + SLICE - 1  # bytes from a string's start to the anchor
            start, end = np.maximum(lo[run], x - far), np.minimum(hi[run], x - near) + LENGTH
            at, before = offsets[row], x - start
            seeds = names[run] ^ k.astype(np.uint64)
            buckets = [xxhash.xxh3_64_intdigest(whole[a:b], seed) - 2**63 for a, b, seed in zip((at + x - near).tolist(), (at + x - far + LENGTH).tolist(), seeds.tolist(), strict=True)]
            salts = [bytes([i]) for i in range(LENGTH)]
            pieces = [hashlib.blake2b(whole[a:b], digest_size=16, salt=salts[d]).digest() for a, b, d in zip((at + start).tolist(), (at + end).tolist(), before.tolist(), strict=True)]
            rows = pa.array(row)
            numbers = [pa.array(c.astype(np.int32)) for c in (start, before, end - start)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(pieces, pa.binary()), batch.column(KEY).take(rows), *numbers, batch.column("times").take(rows)], names=[c.split()[0] for c in schema.split(", ")])

    return _each_once(texts).join(lists, KEY).mapInArrow(cut, schema)


def _open_pieces(texts: DataFrame, slices: DataFrame) -> DataFrame:
    """(suffix_bucket, piece, copies, before, bytes) of suffix buckets with two slices or more, each name once."""
    pieces = stored(slices.groupBy("suffix_bucket", "piece").agg(F.sum("copies").alias("copies"), F.min(F.struct(KEY, "start", "before", "size")).alias("one")), "suffix-pieces")
    several = stored(pieces.groupBy("suffix_bucket").agg(F.sum("copies").alias("n")).filter("n > 1").select("suffix_bucket"), "suffix-open")
    wanted = pieces.join(several, "suffix_bucket").select("suffix_bucket", "piece", "copies", "one.*")
    # written before texts are dealt out, so that their shuffle is alone on disk
    lists = stored(wanted.groupBy(KEY).agg(F.collect_list(F.struct("suffix_bucket", "piece", "copies", "before", "start", "size")).alias("pieces")), "suffix-places")
    dropped(pieces, several)
    schema = "suffix_bucket long, piece binary, copies long, before int, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            whole = raw.tobytes()
            row, some = _flat(batch.column("pieces"))
            begin = offsets[row] + some.field("start").to_numpy()
            parts = [whole[a:b] for a, b in zip(begin.tolist(), (begin + some.field("size").to_numpy()).tolist(), strict=True)]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([*(some.field(c) for c in names[:-1]), pa.array(parts, pa.binary())], names=names)

    out = stored(_each_once(texts).join(lists, KEY).mapInArrow(cut, schema), "suffix-bytes")
    dropped(lists)
    return out


def sorted_repeats(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, first and last offset) of the strings of a block that occur twice or more, copies counted."""
    anchor, parts = table["before"].to_numpy().astype(np.int64), table["bytes"].to_pylist()
    n = np.array([len(x) - LENGTH + 1 for x in parts], dtype=np.int64)
    # each slice lies so that its anchor is at a whole period
    text, places, at = bytearray(), np.zeros(len(parts), dtype=np.int64), 0
    for i, part in enumerate(parts):
        at = len(text) + (-(len(text) + int(anchor[i]))) % PERIOD
        text.extend(b"\0" * (at - len(text)))
        text.extend(part)
        places[i] = at
    text.extend(b"\0" * (RANKED + PERIOD))
    rows = np.repeat(np.arange(len(parts)), n)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    bucket = np.unique(table["suffix_bucket"].to_numpy(), return_inverse=True)[1]
    groups = bucket[rows] * LENGTH + (anchor[rows] - offset)
    order, classes = block_classes(np.frombuffer(bytes(text), dtype=np.uint8), places[rows] + offset, groups)
    copies = table["copies"].to_numpy()[rows]
    found = np.zeros(len(rows) + 1, dtype=bool)
    found[order] = np.bincount(classes, weights=copies[order])[classes] > 1
    # neighbouring strings of a slice as one range
    joins = np.concatenate([[False], found[:-2] & found[1:-1] & (rows[1:] == rows[:-1]), [False]])
    first, last = np.flatnonzero(found[:-1] & ~joins[:-1]), np.flatnonzero(found[:-1] & ~joins[1:])
    return rows[first], offset[first], offset[last]


def _sorted(pieces: DataFrame) -> DataFrame:
    """(piece, lo, hi): repeated strings by slice, from ``pieces`` (suffix_bucket, before, piece, bytes, copies)."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            # a bucket of one row, seen once, has nothing to be equal to
            code = np.unique(table["suffix_bucket"].to_numpy(), return_inverse=True)[1]
            table = table.filter(pa.array(np.bincount(code, weights=table["copies"].to_numpy())[code] > 1))
            row, lo, hi = sorted_repeats(table) if len(table) else (np.zeros(0, np.int64),) * 3
            names = table["piece"].combine_chunks().take(pa.array(row))
            return pa.RecordBatch.from_arrays([names, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["piece", "lo", "hi"])

        held, size, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            buckets = batch.column("suffix_bucket").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)]])
            weights = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64))])
            begin = 0
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                # a block ends only where a suffix bucket does
                if size + weights[i] - weights[begin] >= BLOCK_BYTES and buckets[i] != last:
                    held.append(batch.slice(begin, i - begin))
                    yield solved(held)
                    held, size, begin = [], 0, i
                last = buckets[j - 1]
            held.append(batch.slice(begin))
            size += int(weights[-1] - weights[begin])
        if held:
            yield solved(held)

    dealt = pieces.select("suffix_bucket", "before", "piece", "bytes", "copies").repartition("suffix_bucket").sortWithinPartitions("suffix_bucket")
    return dealt.mapInArrow(sort, "piece binary, lo int, hi int")


def _repeats(pieces: DataFrame) -> DataFrame:
    """(piece, lo, hi) of all ``pieces``; buckets too wide for a block are dealt anew, string by string."""
    wide = stored(pieces.groupBy("suffix_bucket").agg(F.sum(F.length("bytes")).alias("size")).filter(F.col("size") > WIDE_BYTES).select("suffix_bucket"), "suffix-wide")
    found = _sorted(pieces.join(wide, "suffix_bucket", "left_anti"))
    string = F.expr(f"substring(bytes, offset + 1, {LENGTH})")
    single = pieces.join(wide, "suffix_bucket").select("piece", "before", "bytes", "copies", F.explode(F.sequence(F.lit(0), F.length("bytes") - LENGTH)).alias("offset"))
    single = single.select("piece", "offset", "copies", (F.col("before") - F.col("offset")).alias("before"), string.alias("bytes"))
    name = F.substring(F.unhex(F.sha2(F.concat(F.col("before").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("bytes")), 256)), 1, 16)
    strings = single.groupBy("before", "bytes").agg(F.sum("copies").alias("copies"))
    twice = stored(_sorted(strings.select(F.xxhash64("before", "bytes").alias("suffix_bucket"), "before", name.alias("piece"), "bytes", "copies")), "suffix-twice")
    again = single.select("piece", "offset", name.alias("string")).join(twice.select(F.col("piece").alias("string")), "string")
    return found.union(again.select("piece", F.col("offset").alias("lo"), F.col("offset").alias("hi")))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(text_key, starts): where repeated strings start, as (lo, hi) ranges of each text."""
    texts = _keyed(docs)
    runs = stored(_anchored(texts), "suffix-runs")
    # tables are written where the next join is to split a key that many rows share
    shared = stored(runs.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "suffix-shared")
    lists = stored(runs.join(shared, "bucket").groupBy(KEY).agg(F.collect_set(F.struct("lo", "hi", "anchor", "bucket")).alias("runs")), "suffix-lists")
    dropped(runs, shared)
    slices = stored(_slices(texts, lists), "suffix-slices")
    dropped(lists)
    pieces = _open_pieces(texts, slices)
    found = stored(_repeats(pieces), "suffix-found")
    dropped(pieces)
    ranges = slices.select(KEY, "start", "piece").join(found, "piece").select(KEY, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    starts = stored(ranges.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("starts")), "suffix-starts")
    dropped(slices, found)
    return starts


def kept_parts(raw: bytes, starts: list[dict]) -> tuple[list[bytes], int, int]:
    """What stays of ``raw``, the bytes removed, and the number of removed runs."""
    parts, at, removed, spans, end = [], 0, 0, 0, -1
    for s in starts:
        lo, hi = s["lo"], s["hi"] + LENGTH
        if lo > end:
            parts.append(raw[at:lo])
            spans += 1
            end = lo
        if hi > end:
            removed += hi - max(lo, end)
            at = end = hi
    parts.append(raw[at:])
    return parts, removed, spans


def removed_spans(starts: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the removed runs of a batch, whose texts lie at ``offsets`` in its bytes."""
    row, ranges = _flat(starts)
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    lo, hi = offsets[row] + ranges.field("lo").to_numpy(), offsets[row] + ranges.field("hi").to_numpy() + LENGTH
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], (lo[1:] > reach[:-1]) | (row[1:] != row[:-1])])
    return row[new], lo[new], reach[np.concatenate([new[1:], [True]])]


def repeat_table(docs: DataFrame) -> DataFrame:
    """Each document's bytes, what was removed, and the digest of what stays."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            row, first, last = removed_spans(batch.column("starts"), offsets)
            n, whole = len(batch), memoryview(raw)
            removed, spans = np.bincount(row, weights=last - first, minlength=n).astype(np.int64), np.bincount(row, minlength=n)
            ends, firsts, lasts, i, kept = np.cumsum(spans).tolist(), first.tolist(), last.tolist(), 0, []
            for at, end, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ends, strict=True):
                hashed = hashlib.sha256()
                while i < stop:
                    hashed.update(whole[at : firsts[i]])
                    at, i = lasts[i], i + 1
                hashed.update(whole[at:end])
                kept.append(hashed.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (np.diff(offsets), removed, spans)), pa.array(kept, pa.string())], names=[x.split()[0] for x in schema.split(", ")])

    starts = repeated_starts(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _text_key(F.col("text")).alias(KEY))
    return keyed.join(starts, KEY, "left").select("doc_id", "text", "starts").mapInArrow(digest, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of the text; broken characters become U+FFFD."""
    starts = repeated_starts(docs)
    columns, schema = docs.columns, docs.schema
    plain = docs.toDF(*(f"in_{i}" for i in range(len(columns))))
    at = columns.index("text")
    keyed = plain.withColumn(KEY, _text_key(F.col(f"in_{at}")))
    joined = keyed.join(starts, KEY, "left").drop(KEY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t.as_py() is None else b"".join(kept_parts(t.as_py().encode(), s.as_py() or [])[0]).decode(errors="replace") for t, s in zip(batch.column(at), batch.column("starts"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    return joined.mapInArrow(cut, schema)

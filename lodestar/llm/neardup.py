r"""Near-duplicate documents: one-permutation MinHash with optimal densification.

One hash of every word shingle gives its bin and its value; empty bins copy
from bins drawn by a fixed sequence until a full one is met.  Runs of ``ROWS``
bins are bands, and documents that share a band share a bucket.  Equal sets
are one node from the start.  In every bucket only the edges from its smallest
document to the others are candidates (a star), so candidates are linear in
the buckets; all are confirmed on the full shingle sets.

A star can miss the link of two members that are both unlike its centre.
So members of buckets that still span several components are taken up again,
with an exact candidate test: sets with similarity t share one of the
``n - ceil(t * n) + 1`` rarest shingles of each (rare by a table of ``COUNTS``
counters, any order would do).  Members of different components that share
such a shingle are one group.  In a group all members outside its largest
component are compared with all others, in blocks, by size and by a mark of
``MARK`` bits, each the parity of the shingles that fall on it: two marks
differ in no more bits than the sets in shingles, so no link is lost.  A task
returns a forest over the pairs that pass.  Its edges are confirmed on full
sets; only clusters of the forest that still span several components are
compared whole, in blocks of about ``BLOCK`` sets a side, each text going to
its one cluster; a task returns only links that join components.
No bucket or group is capped, sampled or collected whole.

Words are ``[^\x20\x09-\x0D]+`` after lower-casing A-Z; shingles are told apart
by 64-bit hashes over two prime moduli a word.  Defined results: a document of
fewer than ``width`` words is one shingle; null or empty text has no shingles
and is linked with nothing; documents are nodes by ``doc_id``, so rows of one
id are one node with the links of all of them (its ``n_shingles`` stand row by
row); a row without id stands alone and is kept (its component is null); ties
fall to the smallest id; very long texts are compared whole; an empty table
gives no rows.  ``near_dup_kept`` keeps all rows of a kept id but repeats equal
in id and text, of which any one stays; further columns stay there and are
ignored by ``near_dup_table``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm.graph import components
from lodestar.llm.scratch import dropped, stored
from lodestar.llm.wordhash import PrimeHasher, WordHasher, mix, shingles, utf8_parts

BINS = 128
ROWS = 4
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Rows and bits of the marks that are compared before sets are.
WIDE_BLOCK = 2048
MARK = 1024
#: Counters by which shingles are told rare or common; all of them reach the driver.
COUNTS = 1 << 20
#: A link needs PER_CENT * union <= 100 * intersection.
PER_CENT = 80
EMPTY = np.uint64(2**64 - 1)


def densify(signature: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Fills empty bins from full ones; all documents draw the same bins in the same order."""
    out, todo = signature.copy(), empty & ~empty.all(axis=1, keepdims=True)
    bins = signature.shape[1]
    draws = np.random.default_rng(2017)
    while todo.any():
        drawn = draws.integers(0, bins, bins)
        rows, at = np.nonzero(todo)
        full = ~empty[rows, drawn[at]]
        rows, at = rows[full], at[full]
        out[rows, at] = signature[rows, drawn[at]]
        todo[rows, at] = False
    return out


def signatures(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    n = len(firsts) - 1
    rows = np.repeat(np.arange(n), np.diff(firsts))
    signature = np.full((n, BINS), EMPTY, dtype=np.uint64)
    np.minimum.at(signature.ravel(), rows * BINS + (hashes >> np.uint64(64 - 7)).astype(np.int64), hashes)
    return densify(signature, signature == EMPTY)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64), bands.shape[:2])
    for row in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, row])
    return key.view(np.int64)


def shingle_sets(column: pa.Array, width: int, hasher: WordHasher) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(first row, last row, distinct shingles of each, all shingles, their offsets)."""
    for a, b, words, firsts in hasher.words(column):
        hashes, at = shingles(words, firsts, width)
        yield a, b, [np.unique(hashes[at[i] : at[i + 1]]) for i in range(b - a)], hashes, at


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band keys."""
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PrimeHasher()
        for batch in batches:
            for a, b, sets, hashes, at in shingle_sets(batch.column("text"), width, hasher):
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                prints = [np.array([int(mix(x ^ np.uint64(salt)).sum(dtype=np.uint64)) for x in sets], dtype=np.uint64).view(np.int64) for salt in (0x1F83D9AB, 0x5BE0CD19)]
                keys = band_keys(signatures(hashes, at))
                held = np.flatnonzero(sizes)
                counts = np.zeros(b - a + 1, dtype=np.int32)
                counts[held + 1] = keys.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys[held].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes), *map(pa.array, prints), bands], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, schema)


def is_link(both: int, a: int, b: int) -> bool:
    return 100 * both >= PER_CENT * (a + b - both)


def shingle_table(docs: DataFrame, width: int) -> DataFrame:
    """(node, set): the distinct shingle ids of each row's text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PrimeHasher()
        for batch in batches:
            for a, b, sets, _, _ in shingle_sets(batch.column("text"), width, hasher):
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["node", "set"])

    return docs.mapInArrow(read, "node long, set array<long>")


def wanted_sets(docs: DataFrame, sketches: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of ``wanted`` ids; only ids of several rows are looked through for repeats."""
    several = stored(sketches.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "near-several")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id", "left_semi")
    name = F.sha2(F.concat_ws(",", F.col("set").cast("array<string>")), 256)
    of_several = shingle_table(narrow.join(several, "doc_id", "left_semi"), width).groupBy("node", name.alias("print")).agg(F.any_value("set").alias("set")).drop("print")
    return shingle_table(narrow.join(several, "doc_id", "left_anti"), width).unionByName(of_several)


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose documents' full sets are similar enough."""
    left = edges.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    paired = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return paired.filter(100 * both >= PER_CENT * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct()


def joining_links(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], first: np.ndarray) -> list[tuple[int, int]]:
    """Links between the two sides (``first`` and the rest, or within one side) that join different groups."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    # a shingle of one document alone is in no intersection
    shared = np.bincount(code, minlength=len(tokens))[code] > 1
    rows, code = rows[shared], np.unique(code[shared], return_inverse=True)[1]
    one, other = (np.flatnonzero(first), np.flatnonzero(~first)) if (~first).any() else (np.arange(len(sets)),) * 2
    both = np.zeros((len(one), len(other)), dtype=np.float32)
    place = np.zeros(len(sets), dtype=np.int64)
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    slab = 4096
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, slab):
        lo, hi = np.searchsorted(code, [start, start + slab])
        table = np.zeros((len(sets), slab), dtype=np.float32)
        table[rows[lo:hi], code[lo:hi] - start] = 1
        both += table[one] @ table[other].T
    union = sizes[one][:, None] + sizes[other][None, :] - both
    near = (100 * both.astype(np.int64) >= PER_CENT * union.astype(np.int64)) & (groups[one][:, None] != groups[other][None, :])
    place = {}

    def root(x: int) -> int:
        while place.setdefault(x, x) != x:
            place[x] = x = place[place[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(int(groups[one[i]])), root(int(groups[other[j]]))
        if a != b:
            place[b] = a
            out.append((int(ids[one[i]]), int(ids[other[j]])))
    return out


def _counter(shingle_ids: np.ndarray) -> np.ndarray:
    return (shingle_ids.view(np.uint64) % np.uint64(COUNTS)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each counter stand in ``sets``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_counter(batch.column("set").flatten().to_numpy()), minlength=COUNTS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["counter", "n"])

    out = np.zeros(COUNTS, dtype=np.int64)
    for batch in sets.select("set").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow().to_batches():
        out[batch.column("counter").to_numpy()] = batch.column("n").to_numpy()
    return out


def rarest(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(node, component, shingle): the rarest shingles of each set, as many as a similar set cannot all miss."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("set")
            ids, offsets = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(offsets)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((ids, counts[_counter(ids)], rows))
            place = np.arange(len(ids)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            taken = place < (sizes - -(-PER_CENT * sizes // 100) + 1)[rows]
            chosen = pa.array(rows[taken])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(chosen), batch.column("component").take(chosen), pa.array(ids[order][taken])], names=["node", "component", "shingle"])

    return sets.mapInArrow(pick, "node long, component long, shingle long")


def marks(sets: DataFrame) -> DataFrame:
    """(node, size, mark): how many shingles of each set fall on each of ``MARK`` bits, odd or even."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, sizes = part.column("set").flatten().to_numpy().view(np.uint64), np.diff(part.column("set").offsets.to_numpy())
                bits = (mix(ids) % np.uint64(MARK)).astype(np.int64) + MARK * np.repeat(np.arange(len(sizes)), sizes)
                odd = np.packbits(np.bincount(bits, minlength=MARK * len(sizes)).reshape(-1, MARK) & 1, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sizes.astype(np.int64)), pa.array(list(map(bytes, odd)), pa.binary())], names=["node", "size", "mark"])

    return sets.mapInArrow(mark, "node long, size long, mark binary")


def forest(ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray, bits: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect whatever two sets of different groups, one of each side, may be similar by size and mark."""
    one, other = (np.flatnonzero(first), np.flatnonzero(~first)) if (~first).any() else (np.arange(len(ids)),) * 2
    label, out = np.arange(len(ids)), []
    for i in one:
        # what 100 * both >= PER_CENT * union leaves for shingles of one of the two sets
        most = (100 - PER_CENT) * (sizes[i] + sizes[other])
        maybe = (groups[other] != groups[i]) & ((100 + PER_CENT) * np.abs(sizes[other] - sizes[i]) <= most)
        maybe[maybe] = (100 + PER_CENT) * np.bitwise_count(bits[other[maybe]] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most[maybe]
        found = other[maybe]
        roots, at = np.unique(label[found], return_index=True)
        new = roots != label[i]
        out += [(int(ids[i]), int(ids[j])) for j in found[at[new]]]
        label[np.isin(label, roots[new])] = label[i]
    return out


def near_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``forest`` of every (shingle, low, high) of rows sorted by these."""

    def edges(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        column = lambda name: table[name].to_numpy()
        ids, groups, sizes, first = map(column, ("node", "component", "size", "first"))
        raw, _ = utf8_parts(table["mark"])
        bits = raw.reshape(-1, MARK // 8).view(np.uint64)
        found = [x for a, b in itertools.pairwise(bounds) for x in forest(ids[a:b], groups[a:b], sizes[a:b], bits[a:b], first[a:b])]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        key = np.stack([table[name].to_numpy().astype(np.int64) for name in ("shingle", "low", "high")])
        starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]).tolist()
        # the last group may go on in the next batch
        yield edges(table, starts)
        held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield edges(table, [0, table.num_rows])


def in_blocks(held: DataFrame, weights: DataFrame, key: str, most: int, most_size: int = 0) -> DataFrame:
    """(key, low, high, first, node, component): pairs of blocks, each of about ``most`` rows and ``most_size`` shingles of a group.

    Those aside of a group meet all of its blocks, the others only blocks of those aside.
    """
    enough = F.greatest(F.count("*") / most, F.sum("size") / most_size) if most_size else F.count("*") / most
    sizes = weights.groupBy(key, "aside").agg(F.ceil(enough).cast("int").alias("n"))
    sizes = stored(sizes.groupBy(key).agg(F.max(F.when(F.col("aside"), F.col("n"))).alias("n_aside"), F.max(F.when(~F.col("aside"), F.col("n"))).alias("n_main")), "near-sizes")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = held.join(sizes, key).withColumn("block", F.when(F.col("aside"), deal("n_aside")).otherwise(F.col("n_aside") + deal("n_main")))
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("aside"), F.col("n_aside") + F.col("n_main")).otherwise(F.col("n_aside")) - 1))
    paired = dealt.withColumn("other", meets)
    return paired.select(key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") <= F.col("other")).alias("first"), "node", "component")


def rest_links(members: DataFrame, labels: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links inside buckets whose stars left several components."""
    labelled = members.select("node", "band").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band")
    open_keys = stored(open_keys, "near-open-keys")
    nodes = stored(labelled.join(open_keys, "band", "left_semi").select("node", "component").distinct(), "near-open")
    open_sets = stored(sets.join(nodes, "node"), "near-open-sets")
    shared = stored(rarest(open_sets, shingle_counts(open_sets)).distinct(), "near-rare")
    # groups by shingle; of shingles with the same members one is enough
    print_of = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(20)"))
    groups = shared.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component", True).alias("main"), F.count("*").alias("n"), print_of(1).alias("print_a"), print_of(2).alias("print_b"))
    groups = groups.filter("low <> high").groupBy("n", "print_a", "print_b").agg(F.min(F.struct("shingle", "main")).alias("one")).select("one.*")
    held = stored(shared.join(stored(groups, "near-groups"), "shingle").withColumn("aside", F.col("component") != F.col("main")), "near-held")
    dropped(open_keys, shared)
    marked = stored(marks(open_sets), "near-marks")
    paired = in_blocks(held, held.select("shingle", "aside"), "shingle", WIDE_BLOCK).join(marked, "node")
    near = stored(paired.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "node").mapInArrow(near_forest, "a long, b long").distinct(), "near-forest")
    links = stored(confirmed(near, open_sets.select("node", "set")), "near-forest-links")
    known = labels.select(F.col("component").alias("a"), F.col("node").alias("b")).union(links)
    grown = components(known, "near-grown").withColumnRenamed("component", "grown")
    clusters = components(near, "near-clusters").select("node", F.col("component").alias("cluster"))
    placed = stored(clusters.join(nodes, "node").join(grown, "node", "left").select("node", "cluster", F.coalesce("grown", "node").alias("component")), "near-placed")
    split = placed.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.mode("component", True).alias("main")).filter("low <> high").select("cluster", "main")
    left = stored(placed.join(stored(split, "near-split"), "cluster").withColumn("aside", F.col("component") != F.col("main")), "near-left")
    # texts travel: they compress to less than half of their shingle ids
    narrow = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = stored(narrow.join(left.select("node"), "node", "left_semi").dropDuplicates(["node", "text"]), "near-texts")
    weights = left.join(open_sets.groupBy("node").agg(F.sum(F.size("set")).alias("size")), "node")
    full = in_blocks(left, weights, "cluster", BLOCK, BLOCK_SHINGLES).join(texts, "node")

    def compare(table: pa.Table) -> pa.Table:
        sets = [x for _, _, some, _, _ in shingle_sets(table["text"], width, PrimeHasher()) for x in some]
        found = joining_links(table["node"].to_numpy(), table["component"].to_numpy(), sets, table["first"].to_numpy())
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return links.union(full.groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long"))


def classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, node -> component for all nodes that are linked)."""
    sketches = stored(sketch(docs, width), "near-sketches")
    nodes = sketches.filter("n_shingles > 0 and doc_id is not null")
    # written, as are the centres, so that joins with them may split large groups
    equal = stored(nodes.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")), "near-equal")
    # an id with several sets has the bands of all of them
    alone = nodes.join(equal, ["set_a", "set_b"]).filter("doc_id = node").select("node", "bands")
    banded = alone.select("node", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre <> last").select("band", "centre")
    centres = stored(centres, "near-centres")
    members = stored(banded.join(centres, "band"), "near-members")
    dropped(centres)
    # small tables are written where a join is to know their size, and then need not move the texts
    wanted = stored(members.select(F.col("node").alias("doc_id")).distinct(), "near-wanted")
    sets = stored(wanted_sets(docs, sketches, wanted, width), "near-sets")
    stars = stored(members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "near-candidates")
    links = stored(confirmed(stars, sets), "near-links")
    labels = components(links, "near-stars")
    rest = stored(rest_links(members, labels, sets, docs, width), "near-rest")
    dropped(members, sets, links, wanted, stars)
    known = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
    same_set = nodes.join(equal, ["set_a", "set_b"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return sketches, components(known.union(rest).union(same_set), "near-classes")


def near_dup_table(docs: DataFrame, width: int = 5) -> DataFrame:
    """Each document's set size, the smallest document it can be reached from, and whether that is itself."""
    sketches, labels = classes(docs, width)
    joined = sketches.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"))


def near_dup_kept(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each class; of rows equal in id and text one stays."""
    _, labels = classes(docs, width)
    gone = labels.filter("component <> node").select(F.col("node").alias("near_gone"))
    packed = docs.select(F.struct(*docs.columns).alias("near_row"), F.col("doc_id").cast("long").alias("near_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("near_text"), F.col("text").isNull().alias("near_none"))
    left = packed.join(gone, F.col("near_id") == F.col("near_gone"), "left_anti")
    named = left.filter(F.col("near_id").isNotNull()).dropDuplicates(["near_id", "near_text", "near_none"])
    return named.union(left.filter(F.col("near_id").isNull())).select("near_row.*")

"""The trie of rebuilt conversations, summed from its leaves to its root.

A node is a distinct sequence of first turns.  Its name is the exclusive or of
128-bit hashes of its turns with their depths, so names follow from running
totals, and a node's parent is its name without its last turn; no sequence is
ever gathered.

Totals of subtrees go upwards by messages.  A chain of nodes is one message:
every node belongs to the path of that member whose id has the smallest hash,
and a path runs down the trie without a gap.  A path knows how many paths hang
on it; those on which nothing hangs are complete and send their totals to the
path above, which counts down, until only the root's path is left.  Hashes make
the number of rounds grow with the logarithm of the conversations, for however
long conversations.

What is in order (a conversation's turns, a path's nodes) is cut into blocks
first; totals run inside blocks, and over one row a block.

Defined results: null roles and texts are empty; rows without conv_id are left
out; turns of one conversation with equal turn numbers come in the order of
the SHA-256 of role and text; repeated rows are turns of their own;
c - c % 100 rounds towards zero for negative ids; an empty table gives no rows,
otherwise the root is there, also of conversations without turns; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm.scratch import dropped, stored

#: Turns that a conversation takes from the first of its hundred, less one at most.
SHARED = 6
#: Nodes of a path that are summed in one window.
BLOCK = 1 << 15
#: Characters of joined ids in a row.
PIECE = 1 << 20
NAME = ["depth", "k1", "k2"]


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, place, turn_hash, chars): turns with their place from 1 in their conversation.

    Sorted ranges of all turns are the blocks, so a conversation may be of any length.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn_hash = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash.alias("turn_hash"), F.length(text).cast("long").alias("chars"))
    slim = stored(slim.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.asc_nulls_first("turn"), F.asc("turn_hash"), F.asc("row")]
    ranges = stored(slim.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()), "turn-ranges")
    sizes = ranges.groupBy("conv_id", "block").count()
    starts = sizes.withColumn("start", F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter("start > 0").drop("count")
    inside = ranges.withColumn("inside", F.row_number().over(W.partitionBy("conv_id", "block").orderBy(*order)))
    placed = inside.join(starts, ["conv_id", "block"], "left").select("conv_id", "block", (F.col("inside") + F.coalesce("start", F.lit(0))).alias("place"), "turn_hash", "chars")
    out = stored(placed, "turn-places")
    dropped(slim, ranges)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id) of all conversations, their rebuilt turns: conv_id, block, depth, x1, x2, chars)."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("turns"))
    known = lengths.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("first"), shared_turns(F.col("conv_id")).alias("h"))
    firsts = known.filter("conv_id = first").select("first", F.col("turns").alias("first_turns"))
    convs = stored(known.join(firsts, "first", "left").select("conv_id", "first", "h", F.least(F.col("h").cast("long"), F.coalesce("first_turns", F.lit(0))).alias("taken")), "convs")

    heads = turns.filter((F.col("conv_id") % 100 == 0) & (F.col("place") < SHARED)).select(F.col("conv_id").alias("first"), F.col("place").alias("depth"), "turn_hash", "chars")
    taken = convs.join(heads, "first").filter(F.col("depth") <= F.col("taken")).select("conv_id", F.lit(-1).alias("block"), "depth", "turn_hash", "chars")
    own = turns.join(convs, "conv_id").filter(F.col("place") > F.col("h")).select("conv_id", "block", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "chars")
    tag = [F.xxhash64(F.lit(seed), "depth", "turn_hash").alias(f"x{seed}") for seed in (1, 2)]
    return convs.select("conv_id"), taken.unionByName(own).select("conv_id", "block", "depth", *tag, "chars")


def joined_ids(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the conv_ids of each name, ascending and joined by commas.

    The hash itself runs over the ids one after another; sorted ranges join
    theirs first, so a name's task reads few, long rows and holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, size = None, [], 0
        for batch in batches:
            rows = []
            for depth, k1, k2, conv_id in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (at != (depth, k1, k2) or size >= PIECE):
                    rows.append((*at, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                at = (depth, k1, k2)
                ids.append(conv_id)
                size += 20
            yield _batch(rows)
        if ids:
            yield _batch([(*at, ids[0], ",".join(map(str, ids)))])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["depth", "k1", "k2", "least", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        names, sums = [], []
        for batch in batches:
            for depth, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if at != (depth, k1, k2):
                    if at is not None:
                        names.append(at)
                        sums.append(state.hexdigest())
                    at, state = (depth, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _sums(names, sums)
            names, sums = [], []
        if at is not None:
            yield _sums([at], [state.hexdigest()])

    def _sums(names: list[tuple], sums: list[str]) -> pa.RecordBatch:
        columns = list(zip(*names, strict=True)) if names else [[]] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sums, pa.string())], names=[*NAME, "ends_sha256"])

    rows = ends.select(*(F.col(c).cast("long").alias(c) for c in NAME), "conv_id")
    ranges = rows.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id")
    joined = ranges.mapInArrow(pieces, "depth long, k1 long, k2 long, least long, ids string")
    return joined.repartition(*NAME).sortWithinPartitions(*NAME, "least").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(paths: DataFrame) -> DataFrame:
    """(path, leaves, saved) of whole subtrees, from paths (path, above, hanging, leaves, saved).

    Each round the complete paths (``hanging`` 0) send their totals to the
    path above and leave; what stays is written with its counters counted down.
    """
    rounds = [stored(paths, "paths")]
    while True:
        now = rounds[-1]
        messages = now.filter("hanging = 0").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("came"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        zero = F.lit(0)
        rest = now.filter("hanging > 0").join(messages, "path", "left")
        counted = rest.select("path", "above", (F.col("hanging") - F.coalesce("came", zero)).alias("hanging"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"))
        rounds.append(stored(counted, "paths"))
        if not rounds[-1].limit(1).count():
            break
    done = rounds[0]
    for later in rounds[1:]:
        done = done.unionByName(later)
    return done.filter("hanging = 0").select("path", "above", "leaves", "saved")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns."""
    turns = numbered(conversations)
    convs, rows = rebuilt(turns)
    rows = stored(rows, "rebuilt")
    # running totals: over one row a block, then inside a block
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    so_far = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(f"b{i}").over(so_far), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    running = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.select("*", *(F.bit_xor(f"x{i}").over(running).alias(f"r{i}") for i in (1, 2)))
    key = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    named = inside.join(blocks, ["conv_id", "block"]).select("conv_id", "depth", *(k.alias(f"k{i}") for i, k in enumerate(key, 1)), *(k.bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i, k in enumerate(key, 1)), "chars")

    member = F.struct(F.xxhash64("conv_id").alias("hash"), "conv_id")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(member).getField("conv_id").alias("path")).filter("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in (*NAME, "p1", "p2", "chars")), "conv_id", "n_convs", "path")
    grouped = named.groupBy(*NAME).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(member).getField("conv_id").alias("path"))
    nodes = stored(grouped.unionByName(root), "nodes")

    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(below, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # what a child takes from its parent: the path it may hang on, and the parent's conv_id
    above = nodes.select(F.col("depth").alias("up_depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    counted = stored(counted.withColumn("up_depth", F.col("depth") - 1), "counted")
    linked = counted.join(above, (counted["up_depth"] == above["up_depth"]) & (counted["p1"] == above["up1"]) & (counted["p2"] == above["up2"]), "left").drop("up_depth", "up1", "up2")
    linked = stored(linked.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "linked")
    whole = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    ends = convs.join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NAME))
    ends = stored(joined_ids(ends), "ends")
    dropped(rows, turns, nodes, counted)

    own = linked.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = linked.filter("above IS NULL OR above <> path")
    hanging = tops.filter("above IS NOT NULL").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("hanging"))
    paths = tops.select("path", "above").join(own, "path").join(hanging, "path", "left").select("path", "above", F.coalesce("hanging", F.lit(0)).alias("hanging"), "leaves", "saved")
    totals = peeled(paths)

    # what arrives at a node from the paths that hang on it, then sums up each path from below
    hung = tops.filter("above IS NOT NULL").select("path", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).join(totals.select("path", F.col("leaves").alias("l"), F.col("saved").alias("s")), "path")
    arrived = hung.groupBy(*NAME).agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    with_all = linked.join(arrived, NAME, "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
    with_all = stored(with_all.drop("l", "s").withColumn("block", F.floor(F.col("depth") / BLOCK)), "arrived")
    upward = W.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    deeper = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    parts = with_all.groupBy("path", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).select("path", "block", F.sum("l").over(deeper).alias("l"), F.sum("s").over(deeper).alias("s")).filter("l IS NOT NULL")
    summed = with_all.withColumns({"leaves": F.sum("leaves").over(upward), "saved": F.sum("saved").over(upward)}).join(parts, ["path", "block"], "left")

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends, NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS first, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: unicode(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), taken AS (
  SELECT c.*, least(h, coalesce(n, 0)) AS taken FROM convs c LEFT JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) s ON s.conv_id = c.first
), rows AS (
  SELECT c.conv_id, t.place AS depth, turn_hash, chars FROM taken c JOIN turns t ON t.conv_id = c.first AND t.place <= c.taken
  UNION ALL SELECT c.conv_id, t.place - h + taken, turn_hash, chars FROM taken c JOIN turns t ON t.conv_id = c.conv_id AND t.place > h
), named AS (
  SELECT conv_id, depth, chars, sha256(string_agg(turn_hash, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM rows UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), linked AS (
  SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM named
), nodes AS (
  SELECT depth, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved FROM linked GROUP BY depth, k
), counted AS (
  SELECT n.*, coalesce(c, 0) AS n_children FROM nodes n LEFT JOIN (SELECT depth - 1 AS depth, up AS k, count(*) AS c FROM nodes GROUP BY ALL) USING (depth, k)
), under AS (
  SELECT a.depth, a.k, count(*) FILTER (n.n_children = 0) AS n_leaves, sum(n.saved) AS saved_tokens FROM counted n JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY ALL
), ends AS (
  SELECT depth, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, max(depth) AS depth, max_by(k, depth) AS k FROM named GROUP BY conv_id) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted n JOIN under USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.up
"""

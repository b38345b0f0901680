"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is a string over words.  Of its runs of ``K`` words those are anchors
whose smallest inner run of ``S`` words (by hash) stands at the run's first or
last place.  Whether a run is an anchor depends on its own words only, so an
edit elsewhere leaves it, and at least one of any ``K - S`` neighbouring runs is
one.  The fingerprint holds the ``KEPT`` smallest hashes of a text's distinct
anchors; likeness is the share of common ones among the smallest of both, an
estimate of the share of common anchors (exact up to ``KEPT`` of them).  With
their places, anchors tell how far two texts agree word by word.

Words are cut at ASCII white space; words of over ``LONG`` characters (texts
without blanks) become pieces of ``PIECE`` characters.  Defined results: a null
text is the empty text; a text without an anchor, as one of fewer than ``K``
words, has its whole word sequence as its one anchor, at place 0; without words
the fingerprint is empty, and two empty ones are alike (1), an empty and
another one not (0).  Equal texts have equal fingerprints wherever they stand.
Very long texts: arrays of their words, inside their row.  Ties and repeated
rows of one id come in the order of their text's hash, then of their text;
null ids come after all others; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K, S = 5, 2
KEPT = 64
LONG, PIECE = 64, 8
#: Ranges of ids that the table is cut into for each shuffle partition, and at most.
RANGES, MOST_RANGES = 4, 4096


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; long ones in pieces."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / PIECE).cast("int")), lambda i: F.substring(w, i * PIECE + 1, F.lit(PIECE)))
    cut = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > LONG, pieces(w)).otherwise(F.array(w))))
    return let(found, lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > LONG), cut(ws)).otherwise(ws))


def anchors(ws: Column, k: int = K, s: int = S) -> Column:
    """array<struct<place int, anchor long>>: closed syncmers of a word array, by place; anchors are 32-bit hashes."""
    inner = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - s), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(s))))
    width = k - s
    least = lambda hs, i: F.least(*(F.get(hs, i + j) for j in range(width + 1)))
    edge = lambda hs: F.filter(F.sequence(F.lit(0), F.size(hs) - 1 - width), lambda i: F.least(F.get(hs, i), F.get(hs, i + width)) == least(hs, i))
    short = lambda value: F.shiftrightunsigned(value, 32)
    named = lambda ws, places: F.transform(places, lambda i: F.struct(i.alias("place"), short(F.xxhash64(*(F.get(ws, i + j) for j in range(k)))).alias("anchor")))
    whole = lambda ws: F.array(F.struct(F.lit(0).alias("place"), short(F.xxhash64(F.lit(k), F.array_join(ws, " "))).alias("anchor")))
    none = F.array().cast("array<struct<place:int,anchor:bigint>>")
    chosen = lambda ws: let(named(ws, let(inner(ws), edge)), lambda found: F.when(F.size(found) > 0, found).otherwise(whole(ws)))
    return let(ws, lambda ws: F.when(F.size(ws) == 0, none).when(F.size(ws) < k, whole(ws)).otherwise(chosen(ws)))


def smallest(found: Column, kept: int = KEPT) -> Column:
    """The ``kept`` smallest distinct anchors, in order."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda a: a["anchor"]))), 1, kept)


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Estimated share of common anchors of two lists from ``smallest``, 0 to 1."""
    both = let(F.slice(F.array_sort(F.array_union(a, b)), 1, kept), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def written(kept: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits an anchor."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def agreed(a: Column, b: Column, k: int = K) -> Column:
    """Words from the start to the end of the last anchor that two texts have at one place; 0 without one."""
    return F.coalesce(F.array_max(F.transform(F.array_intersect(a, b), lambda x: x["place"])) + k, F.lit(0))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``anchors`` (place and hash of each) and ``fingerprint``."""
    found = docs.withColumn("anchors", anchors(words(F.col(text))))
    return found.withColumn("fingerprint", written(smallest(F.col("anchors"))))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id and ``columns`` of each row, and as ``next_...`` those of the next one by descending id, the first after the last.

    Ranges of ids become windows, in one shuffle of the rows: range borders
    are quantiles of the ids, at most ``MOST_RANGES``.  The first row of each
    range is sent to the range before it as well, as its guest, so that no
    window needs more than its own rows.  Ids that fill whole ranges by
    themselves, and null ids, are cut further by the hash of their text.
    """
    spark = docs.sparkSession
    n = min(MOST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = docs.agg(F.approx_percentile("doc_id", [i / n for i in range(1, n)], F.lit(4 * n))).first()[0] or []
    heavy = {a for a, b in zip(borders, borders[1:], strict=False) if a == b}
    place = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(F.size(F.filter(F.array(*map(F.lit, sorted(set(borders)))).cast("array<bigint>"), lambda b: b > F.col("doc_id"))))
    fine = F.col("doc_id").isNull() | (F.col("doc_id").isin(*heavy) if heavy else F.lit(False))
    part = F.struct(place.alias("range"), F.when(fine, F.shiftright("_hash", 58) + 32).otherwise(-1).alias("cut"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash"), F.col("text").asc_nulls_first()]

    rows = docs.select("doc_id", *columns, F.xxhash64("text").alias("_hash")).withColumn("_part", part)
    # one row a range from here: the first of each, and the range before it
    down = F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), "_hash", "doc_id")
    first = docs.select("doc_id", F.xxhash64("text").alias("_hash")).withColumn("_part", part).groupBy("_part").agg(F.min(down).alias("head"))
    before = F.coalesce(F.lag("_part").over(W.orderBy("_part")), F.max("_part").over(W.orderBy(F.lit(0))))
    heads = first.select(F.col("head.doc_id").alias("_id"), F.col("head._hash").alias("_head_hash"), before.alias("_before"))

    matched = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_head_hash")), "left")
    own, guest = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("_before").alias("part"), F.lit(True).alias("guest"))
    twice = matched.withColumn("_at", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    window = W.partitionBy("_at.part").orderBy(F.col("_at.guest"), *order)
    return twice.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns)).filter(~F.col("_at.guest")).select("doc_id", *columns, *(f"next_{c}" for c in columns))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and their likeness."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(texts.withColumn("kept", smallest(anchors(words(F.col("text"))))), ["text", "kept"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    edited = edited.withColumn("edited_kept", smallest(anchors(words(F.col("edited")))))
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("kept")).alias("fingerprint"),
        written(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
    )

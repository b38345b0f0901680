"""Perspective rotation of multi-party dialogues, in DataFrame operations only.

For every speaker of a dialogue the dialogue is rendered once with that
speaker as the assistant and all others as named users; the mask lists the
character spans that the assistant wrote.  A rendering is stored in parts of
``turns_per_part`` turns, so a dialogue that holds a large share of all rows is
spread over many tasks.  Parts are pieces of one text: ``part_offset`` is where
a part begins in it, masks count from the beginning of the whole, every
speaker has all parts, and the parts of a rendering joined in order are it.

Turns are numbered by one sort over all rows, cut into ranges of bounded size
whatever their keys, so neither a long dialogue nor one turn number or null
turns of many rows meet in one task.

Defined results: null text is empty, a null role is ``unknown``, a null turn
stands first, a null dialogue id is an id of its own; turns of one number are
ordered by role and text; rows equal in all four columns are rendered once;
roles in ``context_roles`` are rendered as context and are no speakers, so a
dialogue of context alone gives no rows; markers inside texts and roles are
broken up; very long texts are rendered whole; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm.scratch import stored

TURNS_PER_PART = 256
CONTEXT_ROLES = ("system",)


def _plain(column: Column) -> Column:
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def _numbered(turns: DataFrame, turns_per_part: int) -> DataFrame:
    """Distinct turns with ``part``, the number of turns before in the dialogue by ``turns_per_part``."""
    clean = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        _plain(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))).alias("role"),
        _plain(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).distinct()
    order = ["conv_id", "turn", "role", "text"]
    # numbers rise inside a range and from range to range; written, so that they stay
    ranged = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")), "chat-turns")
    ranges = placed.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("range")) - F.col("n")
    starts = stored(ranges.select(F.col("conv_id").alias("range_conv"), "range", (F.col("first") - before).alias("zero")), "chat-ranges")
    joined = placed.join(starts.withColumnRenamed("range", "range_at"), F.col("conv_id").eqNullSafe(F.col("range_conv")) & (F.col("range") == F.col("range_at")))
    return joined.select("conv_id", "turn", "role", "text", F.floor((F.col("place") - F.col("zero")) / turns_per_part).cast("long").alias("part"))


def rotate_perspectives(turns: DataFrame, turns_per_part: int = TURNS_PER_PART, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row per (conv_id, part, speaker): the rendered text, where it begins in the whole, and its mask."""
    numbered = _numbered(turns, turns_per_part)
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # a part's length for a speaker: all turns as others see them, less what the speaker's own heads are shorter
    spoken = numbered.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    heads = F.when(F.col("role").isin(*context_roles), 5).otherwise(10) + F.length("role")
    all_chars = spoken.groupBy("conv_id", "part").agg(F.sum(F.col("chars") + F.col("n") * (heads + 8)).alias("chars"))
    speakers = spoken.filter(~F.col("role").isin(*context_roles)).select("conv_id", F.col("role").alias("speaker")).distinct()
    own = spoken.select(F.col("conv_id").alias("own_conv"), F.col("part").alias("own_part"), F.col("role").alias("own_role"), F.col("n").alias("n_own"))
    each = all_chars.join(speakers.withColumnRenamed("conv_id", "speaker_conv"), F.col("conv_id").eqNullSafe(F.col("speaker_conv"))).drop("speaker_conv")
    each = each.join(own, F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("part") == F.col("own_part")) & (F.col("speaker") == F.col("own_role")), "left")
    along = W.partitionBy("conv_id", "speaker").orderBy("part")
    length = F.col("chars") + F.coalesce("n_own", F.lit(0)) * (4 - F.length("speaker"))
    offsets = stored(each.select(F.col("conv_id").alias("speaker_conv"), F.col("part").alias("speaker_part"), "speaker", (F.sum(length).over(along) - length).alias("part_offset")), "chat-offsets")
    each = parts.join(offsets, F.col("conv_id").eqNullSafe(F.col("speaker_conv")) & (F.col("part") == F.col("speaker_part"))).drop("speaker_conv", "speaker_part")

    def rendered(turn: Column) -> Column:
        own = turn["role"] == F.col("speaker")
        head = F.when(own, F.lit("<|assistant|>\n")).when(turn["role"].isin(*context_roles), F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), turn["role"], F.lit("|>\n")))
        return F.struct(own.alias("own"), head.alias("head"), F.concat(turn["text"], F.lit("<|end|>\n")).alias("body"))

    def placed(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["head"])
        span = F.struct(start.alias("start"), F.length(piece["body"]).alias("length"))
        return F.struct(
            (start + F.length(piece["body"])).alias("at"),
            F.when(piece["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    nothing = F.struct(F.col("part_offset").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:int>>)").alias("spans"))
    pieces = each.withColumn("pieces", F.transform("turns", rendered))
    masked = pieces.withColumn("spans", F.aggregate("pieces", nothing, placed)["spans"])
    return masked.select(
        "conv_id",
        "part",
        "speaker",
        "part_offset",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size("spans").cast("long").alias("n_own_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("+"), s["length"].cast("string"))), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("masked_chars"),
    )


ORACLE_SQL = """
WITH clean AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), placed AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) // 256 AS part FROM clean
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM clean WHERE role <> 'system'
), pieces AS (
  SELECT p.conv_id, part, speaker, turn, role, text, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head,
    text || '<|end|>' || chr(10) AS body
  FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), spans AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM pieces
)
SELECT conv_id, part, speaker, CAST(min(begins) AS BIGINT) AS part_offset, count(*) AS n_turns, count(*) FILTER (own) AS n_own_turns,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
  coalesce(string_agg(CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '+' || CAST(length(body) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS masked_chars
FROM spans GROUP BY conv_id, part, speaker
"""

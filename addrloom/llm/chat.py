"""Logged conversations that only begin longer ones, collapsed; the rest rendered.

A log often holds a conversation once per turn, each snapshot being the beginning of the next.  Every turn
gets the hash of the conversation up to it.  A conversation whose last hash occurs inside another one
is a beginning of it; an anti-join keeps the others, one per group of equals.

Hashes roll along range partitions of (conversation, turn), not along conversations: one of any
length is cut where a partition ends, and what the cut part adds is carried over from a table
of a few rows per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.shared import stored

TURNS_PER_PART = 512
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(salt: int, *values: Column) -> Column:
    """A hash that tells a null from an empty text."""
    return F.xxhash64(F.lit(salt), *[x for v in values for x in (v.isNull(), F.coalesce(v, F.lit("")))])


def _carried(rows: DataFrame, edges: DataFrame, **sums: Column) -> DataFrame:
    """``part``, ``conv`` and, per name, what the earlier partitions of a cut conversation add up to.
    ``edges`` holds the first and last conversation of every partition, so this stays as small.  Counts
    add, hashes combine by exclusive or."""
    cut = rows.join(F.broadcast(edges), "conv", "left_semi").groupBy("conv", "part").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = {n: (F.sum(n) if n == "count" else F.bit_xor(n)).over(before) for n in sums}
    return cut.select("conv", "part", *[F.coalesce(c, F.lit(0).cast("long")).alias(f"carried_{n}") for n, c in over.items()])


def prefixes(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """Every turn with its ``position`` from 1, the rolling hashes ``p`` of the conversation up to it, and
    whether it is the ``last``; columns conv, role, text, position, p, last.

    Turns are ordered by turn (nulls first), equal ones by role and text hash.  Rows without a conversation id
    belong to no conversation and are left out.  Null and empty roles and texts differ.
    """
    role, text = F.col(f"`{role_column}`").cast("string"), F.col(f"`{text_column}`").cast("string")
    rows = conversations.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").alias("conv"), F.col(f"`{turn_column}`").alias("turn"), role.alias("role"), text.alias("text"),
        _hash(1, role, text).alias("a"), _hash(2, text, role).alias("b"), F.monotonically_increasing_id().alias("number"),
    )
    order = [F.col(c) for c in ("turn", "role", "a", "number")]
    rows = stored(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "chat-ranges")
    ends = rows.groupBy("part").agg(F.min("conv").alias("x"), F.max("conv").alias("y"))
    edges = ends.select(F.explode(F.array("x", "y")).alias("conv")).distinct()
    last_part = rows.join(F.broadcast(edges), "conv", "left_semi").groupBy("conv").agg(F.max("part").alias("last_part"))

    here = Window.partitionBy("part", "conv").orderBy(*order)
    count = _carried(rows, edges, count=F.count(F.lit(1)))
    zero = F.lit(0).cast("long")
    placed = (
        rows.withColumns({"nth": F.row_number().over(here), "next": F.lead("number").over(here)})
        .join(F.broadcast(count), ["part", "conv"], "left").join(F.broadcast(last_part), "conv", "left")
        .withColumn("position", F.col("nth") + F.coalesce("carried_count", zero))
        .withColumn("last", F.col("next").isNull() & (F.coalesce("last_part", "part") == F.col("part")))
        .withColumns({h: F.xxhash64(F.lit(i), "position", "a", "b") for i, h in enumerate("xy")})
        .drop("carried_count", "last_part", "nth", "next")
    )
    carried = _carried(placed, edges, x=F.bit_xor("x"), y=F.bit_xor("y"))
    rolled = placed.withColumns({f"r{h}": F.bit_xor(h).over(here) for h in "xy"})
    rolled = rolled.join(F.broadcast(carried), ["part", "conv"], "left")
    p = F.struct(*[F.col(f"r{h}").bitwiseXOR(F.coalesce(f"carried_{h}", zero)).alias(h) for h in "xy"])
    return rolled.select("conv", "role", "text", "position", p.alias("p"), "last")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv`` and ``copies``: the conversations that begin no longer one, one per group of equals (the
    smallest id) with the size of its group."""
    ends = turns.where("last").groupBy("position", "p").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inside = turns.where("not last").select("position", "p").distinct()
    return ends.join(inside, ["position", "p"], "left_anti").select("conv", "copies", F.col("position").alias("n_turns"))


def render(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Conversations as marked-up text, in parts of at most ``turns_per_part`` turns, so that no task holds a
    conversation of any length whole.  Markers inside a text are broken by a space; a turn without a role
    is of role ``unknown``, without a text an empty one."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.coalesce(F.when(F.trim("role") != "", safe(F.col("role"))), F.lit("unknown"))
    said = F.concat(F.lit(OPEN), role, F.lit("\n"), safe(F.coalesce("text", F.lit(""))), F.lit(CLOSE))
    part = F.floor((F.col("position") - 1) / turns_per_part).cast("int")
    # a part's turns, in order; parts keep a hot conversation out of any one group
    return turns.select(*[c for c in turns.columns if c not in ("role", "text")], part.alias("part"), said.alias("said")).groupBy(
        "conv", "part"
    ).agg(
        F.max("copies").alias("copies"), F.max("n_turns").alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "said"))), lambda t: t["said"]), "\n").alias("rendered"),
    )


def collapse(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """The maximal conversations rendered: id, ``part``, ``copies`` (equal conversations, itself included),
    ``n_turns`` (of the whole conversation) and ``rendered``.

    An empty table gives no rows; other columns are not read.
    """
    turns = stored(prefixes(conversations, id_column, turn_column, role_column, text_column), "chat-prefixes")
    kept = stored(maximal(turns), "chat-maximal")
    rows = turns.select("conv", "role", "text", "position").join(kept, "conv")
    out = render(rows, turns_per_part)
    return out.select(F.col("conv").alias(id_column), "part", "copies", F.col("n_turns").cast("long"), "rendered")

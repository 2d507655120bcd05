"""Intervals that hold a point, without comparing every interval with every point.

Time is a position from 0 to 2**levels - 1. An interval is cut into the few aligned blocks of
powers of two that it consists of, and a point lies in one block of each size. So intervals
and points meet in equal (key, block) pairs, where an aggregate has already reduced the
intervals to what is asked of them: however many share a key, a block is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.operators.joins import lookup


def _blocks(lo: str, hi: str, levels: int) -> Column:
    """The blocks of ``[lo, hi]``: at each size at most one on the left and one on the right."""
    return F.expr(f"""flatten(transform(sequence(0, {levels}), l -> filter(array(
        if(shiftright({lo} + shiftleft(1L, l) - 1, l) < shiftright({hi} + 1, l)
            and shiftright({lo} + shiftleft(1L, l) - 1, l) % 2 = 1,
          named_struct('size', l, 'number', shiftright({lo} + shiftleft(1L, l) - 1, l)), null),
        if(shiftright({lo} + shiftleft(1L, l) - 1, l) < shiftright({hi} + 1, l)
            and shiftright({hi} + 1, l) % 2 = 1,
          named_struct('size', l, 'number', shiftright({hi} + 1, l) - 1), null)
      ), b -> b is not null)))""")


def _holding(at: str, levels: int) -> Column:
    """The blocks that hold a point."""
    return F.expr(
        f"transform(sequence(0, {levels}), l -> named_struct('size', l, 'number', shiftright({at}, l)))"
    )


def least_two(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the two least ids of each key; a key has an id once at most.

    Spark cuts the groups down before it shuffles them, so a hot key is two rows a task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return df.select(*keys, "id").withColumn("_rank", rank).where("_rank <= 2").drop("_rank")


_AT = ["key", "size", "number"]


def _cut(intervals: DataFrame, levels: int) -> DataFrame:
    """Intervals in blocks."""
    kept = [c for c in intervals.columns if c not in ("key", "lo", "hi")]
    return intervals.where("lo <= hi").select(
        "key", F.explode(_blocks("lo", "hi", levels)).alias("b"), *kept
    ).select("key", "b.size", "b.number", *kept)


def _met(points: DataFrame, blocks: DataFrame, levels: int) -> DataFrame:
    """Points with the ``rec`` of each block that holds them."""
    probes = points.select("*", F.explode(_holding("at", levels)).alias("b")).select("*", "b.size", "b.number")
    met = lookup(probes, blocks, {c: F.col(c) for c in _AT}, apart=True)
    return met.where(F.col("rec").isNotNull())


def least_holding(
    intervals: DataFrame, points: DataFrame, levels: int, own: str | None = None
) -> DataFrame:
    """For each point the least ids of the intervals of its key that hold it.

    ``intervals`` has ``key``, ``lo``, ``hi``, ``id``, and those of an id do not overlap;
    ``points`` has ``key``, ``at``, a unique ``point`` and, if named, the id ``own`` that does
    not count. Returns ``point``, ``first`` and ``second`` for points that any interval holds.
    """
    # Two ids of a block are enough: one of them may be the point's own.
    pairs = least_two(_cut(intervals, levels), _AT).groupBy(*_AT).agg(F.collect_list("id").alias("rec"))
    ids = _met(points, pairs, levels).select("point", *([own] if own else []), F.explode("rec").alias("id"))
    if own:
        ids = ids.where(F.col("id") != F.col(own))
    # At most two for each block size, so the sets are small.
    return ids.groupBy("point").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(
        "point", F.get("ids", F.lit(0)).alias("first"), F.get("ids", F.lit(1)).alias("second")
    )


def held_by_others(intervals: DataFrame, points: DataFrame, levels: int) -> DataFrame:
    """Per ``point`` whether an interval of another id than ``own`` holds it (``possible``), and
    whether one does that is marked ``sure``; points that none holds are left out."""
    sure = F.when(F.col("sure"), F.col("id"))
    blocks = _cut(intervals, levels).groupBy(*_AT).agg(F.struct(
        F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.min(sure).alias("sure_lo"), F.max(sure).alias("sure_hi"),
    ).alias("rec"))

    def other(lo: str, hi: str) -> Column:
        # If any id is not the own one, the least or the greatest is not.
        return F.bool_or((F.col(f"rec.{lo}") != F.col("own")) | (F.col(f"rec.{hi}") != F.col("own")))

    return _met(points, blocks, levels).groupBy("point").agg(
        F.struct(other("lo", "hi").alias("possible"), other("sure_lo", "sure_hi").alias("sure")).alias("rec")
    )

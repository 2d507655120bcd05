"""Order-dependent operators whose groups may be larger than a task.

Rows are range-partitioned by the full order and written once, so each row belongs to
a fixed slice; work inside a slice is local, and what has to cross slices is at most a
few rows per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.session import stage

SLICE = "_slice"
PLACE = "_place"


def stage_by_range(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Stage ``df`` in ``order`` with its slice number.

    The slice must be stored: range bounds come from a sample, and computing them again
    for a second consumer or after a lost executor could move rows between slices.
    """
    sliced = df.repartitionByRange(*[F.col(c) for c in order])
    return stage(sliced.withColumn(SLICE, F.spark_partition_id()), label)


def stage_in_order(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """Stage ``df`` in ``order`` with its slice number and ``PLACE``, its row number in it.

    A slice is a folder of its own and places are in the files' statistics, so a reader that
    asks for some places opens nothing else.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        # The low 33 bits count the rows of a partition.
        PLACE: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
        SLICE: F.spark_partition_id(),
    })
    return stage(placed, label, partition=SLICE)


def fill_within(sliced: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Forward-fill, then back-fill ``value`` inside each ``key`` (rows with no key stay).

    ``sliced`` comes from ``stage_by_range`` with ``[key, *order]``. After the forward
    fill only a group's leading nulls are left and all take its first non-null value, so
    no frame looks ahead row by row.
    """
    w = Window.partitionBy(SLICE, key).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    first_local = F.first(value, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    # A key that a slice bound cuts is the greatest of one slice and the least of a later
    # one, so two keys a slice tell them all. For n slices fewer than n keys are cut, and
    # there are fewer than 2n (slice, key) pairs of them: safe to broadcast.
    bounds = sliced.groupBy(SLICE).agg(F.array(F.min(key), F.max(key)).alias("_bounds"))
    cut = (
        bounds.select(SLICE, F.explode("_bounds").alias(key)).where(F.col(key).isNotNull())
        .groupBy(key).agg(F.min(SLICE).alias("lo"), F.max(SLICE).alias("hi"))
        .where("lo < hi").select(key)
    )
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = (
        sliced.join(F.broadcast(cut), key, "left_semi").groupBy(SLICE, key)
        .agg(F.min_by(value, position).alias("head"), F.max_by(value, position).alias("tail"))
    )
    across = Window.partitionBy(key).orderBy(SLICE)
    carried = ends.select(
        SLICE, key,
        F.last("tail", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        F.first("head", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_head"),
    )
    filled = F.coalesce(F.col("_before"), F.col("_carry"), F.col("_head"), F.col("_local"))
    return (
        sliced.withColumns({"_before": before, "_local": first_local})
        .join(F.broadcast(carried), [SLICE, key], "left")
        .withColumn(value, F.when(F.col(key).isNotNull(), filled).otherwise(F.col(value)))
        .select(*sliced.columns)
    )


def number_rows(
    df: DataFrame, order: Sequence[str], start: Column, column: str, label: str
) -> DataFrame:
    """Add consecutive numbers ``start + 1, start + 2, ...`` in ``order``.

    Each slice numbers its own rows; the offsets are one row per slice.
    """
    sliced = stage_by_range(df, order, label)
    counts = sliced.groupBy(SLICE).agg(F.count("*").alias("n"))
    offsets = counts.select(
        SLICE,
        (F.sum("n").over(Window.orderBy(SLICE)) - F.col("n")).alias("_offset"),
    )
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(F.broadcast(offsets), SLICE)
        .withColumn(column, (start + F.col("_offset") + F.col("_local")).cast("long"))
        .drop(SLICE, "_local", "_offset")
    )


def last_before(
    events: DataFrame, queries: DataFrame, key: str, at: str, values: Sequence[str], label: str,
    inclusive: bool = True, bounded: bool = False,
) -> DataFrame:
    """As-of join: for each query the last event with its key at or before its time.

    ``events`` has the columns ``key``, ``at`` and ``values``, each of which is looked up on
    its own and may be null where an event does not count for it; ``queries`` has ``key``,
    ``at`` and others, which are kept. Without ``inclusive`` only earlier times count.

    A key may hold any share of the rows: both sides are ranged together by (key, time), a
    slice looks back over its own rows, and what it takes from those before it is one row for
    each slice: the last event in front of it, which counts where the key is still the same.
    ``bounded`` says that all rows together would fit a task; each key is then one window.
    """
    kept = [c for c in queries.columns if c not in (key, at)]
    side = F.lit(0 if inclusive else 1)
    both = events.select(key, at, side.alias("_side"), *values).unionByName(
        queries.select(key, at, (1 - side).alias("_side"), F.struct(F.lit(1).alias("_q"), *kept).alias("_row")),
        allowMissingColumns=True,
    )
    order = [key, at, "_side"]
    if bounded:
        local = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        found = both.withColumns({
            v: F.when(F.col(key).isNotNull(), F.last(v, ignorenulls=True).over(local)) for v in values
        }).where(F.col("_row").isNotNull())
        return found.select(key, at, *[F.col(f"_row.{c}").alias(c) for c in kept], *values)
    sliced = stage_by_range(both, order, label)
    seen = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(key).alias("k"), F.col(v).alias("v"))) for v in values}
    tails = sliced.groupBy(SLICE).agg(*[
        F.max_by(e, F.when(e.isNotNull(), F.struct(*order))).alias(f"_tail_{v}") for v, e in seen.items()
    ])
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    carried = tails.select(SLICE, *[
        F.last(f"_tail_{v}", ignorenulls=True).over(earlier).alias(f"_carry_{v}") for v in values
    ])
    local = Window.partitionBy(SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = sliced.withColumns({
        f"_seen_{v}": F.last(e, ignorenulls=True).over(local) for v, e in seen.items()
    }).where(F.col("_row").isNotNull()).join(F.broadcast(carried), SLICE, "left")
    out = []
    for v in values:
        last = F.coalesce(F.col(f"_seen_{v}"), F.col(f"_carry_{v}"))
        out.append(F.when(last["k"] == F.col(key), last["v"]).alias(v))
    return found.select(key, at, *[F.col(f"_row.{c}").alias(c) for c in kept], *out)


def running_total(
    df: DataFrame, key: str, at: str, value: str, out: str, label: str, bounded: bool = False
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to and including this time.

    Slices add up their own rows; the sums of earlier slices are a row for each slice and the
    last key it holds, as only that can go on in the next. ``bounded`` as in ``last_before``.
    """
    if bounded:
        so_far = Window.partitionBy(key).orderBy(at).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return df.withColumn(out, F.sum(value).over(so_far).cast("long"))
    sliced = stage_by_range(df, [key, at], label)
    ends = sliced.groupBy(SLICE).agg(F.max(key).alias("_last"))
    tails = (
        sliced.join(F.broadcast(ends), SLICE).where(F.col(key) == F.col("_last"))
        .groupBy(SLICE, key).agg(F.sum(value).alias("_tail"))
    )
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = tails.select(F.col(SLICE).alias("_from"), F.col(key).alias("_k"), F.sum("_tail").over(earlier).alias("_sum"))
    numbers = sliced.groupBy(SLICE).agg(F.min(key).alias("_first"))
    before = (
        numbers.join(summed, (F.col("_first") == F.col("_k")) & (F.col("_from") < F.col(SLICE)))
        .groupBy(SLICE, "_first").agg(F.max_by("_sum", "_from").alias("_before"))
    )
    local = Window.partitionBy(SLICE, key).orderBy(at).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = sliced.withColumn("_local", F.sum(value).over(local)).join(
        F.broadcast(before.select(F.col(SLICE).alias("_s"), "_first", "_before")),
        (F.col(SLICE) == F.col("_s")) & (F.col(key) == F.col("_first")), "left",
    )
    total = F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))
    return joined.select(*df.columns, total.cast("long").alias(out))

"""Lookup joins, last-wins deduplication and keyed updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dedupe_last(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column,
    rec: str = "rec",
) -> DataFrame:
    """Last record per key as ``keys + rec``.

    An aggregate, not a window: it combines map-side, so however many rows share a key
    each task ships one of them.
    """
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias(rec))


#: Bytes of values up to which ``fits`` lets a side be sent to every executor.
BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``df`` take at most ``limit`` bytes: measured by a pass over it.

    For batches against large tables. Estimates do not tell, as those of joins and aggregates
    are far too high, and adaptive execution learns the size only once both sides are shuffled.
    """
    def width(f: T.StructField, c: Column) -> Column:
        if isinstance(f.dataType, T.StructType):
            return sum((width(g, c[g.name]) for g in f.dataType), F.lit(8))
        return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 8

    row = sum((width(f, F.col(f"`{f.name}`")) for f in df.schema), F.lit(0))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= limit


def among(large: DataFrame, keys: DataFrame, on: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows of ``large`` whose ``on`` is among ``keys``, or is not: no shuffle of ``large``
    where the keys fit, else a shuffle join that adaptive execution may split."""
    distinct = keys.select(*on).distinct()
    if fits(distinct):
        distinct = F.broadcast(distinct)
    return large.join(distinct, list(on), "left_semi" if keep else "left_anti")


def lookup(
    left: DataFrame, right: DataFrame, on: Mapping[str, Column], rec: str = "rec",
    hot: bool = True, small: bool = False, apart: bool = False,
) -> DataFrame:
    """Left join adding the struct column ``rec``; null means no hit.

    ``right`` holds at most one row per key: the columns named in ``on`` and ``rec``.
    ``on`` maps each of them to an expression over ``left``.

    No side is broadcast by hint: AQE does so below its size threshold, measured at run
    time. Beyond it, one key may hold much of ``left``. AQE splits such a partition only
    if both join inputs come straight from a shuffle, but ``right`` is usually an
    aggregate already partitioned by the key. With ``hot`` the key's length joins the
    condition, which is implied by equality and makes Spark shuffle ``right`` again, as
    narrow as it is, so that the hot partition can be split.

    ``small`` says that ``right`` was measured (``fits``): it is broadcast, ``left`` not moved.
    ``apart`` shuffles both sides whatever their size, for jobs with dozens of joins: each
    broadcast is built in the driver and stays there until its garbage is collected.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_key_{k}") for k in on], F.col(rec)
    )
    if small:
        renamed, hot = F.broadcast(renamed), False
    elif apart:
        renamed = renamed.hint("merge")
    terms = [expr == F.col(f"_key_{k}") for k, expr in on.items()]
    if hot:
        first, expr = next(iter(on.items()))
        terms.append(F.length(expr) == F.length(F.col(f"_key_{first}")))
    return left.join(renamed, reduce(Column.__and__, terms), "left").drop(
        *[f"_key_{k}" for k in on]
    )


def put(df: DataFrame, hit: Column, values: Mapping[str, Column]) -> DataFrame:
    """Overwrite columns where ``hit`` holds, nulls included; others stay."""
    return df.withColumns({
        c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()
    })


def bulk_update(
    target: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Overwrite ``columns`` of the target rows whose unique ``key`` is updated (K2)."""
    right = updates.select(key, F.struct(*columns).alias("_upd"))
    joined = lookup(target, right, {key: F.col(key)}, "_upd", hot=False)
    values = {c: F.col(f"_upd.{c}") for c in columns}
    return put(joined, F.col("_upd").isNotNull(), values).drop("_upd")


def keep_matching(
    left: DataFrame, keys: DataFrame, on: Mapping[str, Column], hot: bool = True, apart: bool = False
) -> DataFrame:
    """Rows of ``left`` whose key is among the distinct ``keys``."""
    marked = lookup(left, keys.withColumn("_found", F.lit(True)), on, "_found", hot, apart=apart)
    return marked.where(F.col("_found").isNotNull()).drop("_found")


def split_update_create(
    updates: DataFrame, target: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows whose key the target holds, and the rest."""
    existing = target.select(*keys).distinct()
    on = list(keys)
    return updates.join(existing, on, "left_semi"), updates.join(existing, on, "left_anti")

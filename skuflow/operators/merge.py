"""Merge mapped rows into the catalogue; stamp and append catalogue rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions import datetime_text, fold_case, is_blank, utc_now
from skuflow.operators.joins import bulk_update, lookup, put
from skuflow.operators.ordered import number_rows
from skuflow.schemas import CATALOGUE, FEED_ORDER, FULL_KEY, MAPPED_VALUES, RECORD
from skuflow.session import stage


def as_catalogue(rows: DataFrame, now: Column) -> DataFrame:
    """Shape new rows as catalogue rows: missing columns null, both stamps ``now``."""
    have = set(rows.columns)
    stamped = {"created_at", "updated_at"}
    return rows.select(*[
        (
            now if f.name in stamped
            else F.col(f.name) if f.name in have
            else F.lit(None)
        ).cast(f.dataType).alias(f.name)
        for f in CATALOGUE
    ])


def next_id_after(table: DataFrame) -> Column:
    """Highest id in use, as a scalar subquery."""
    return F.coalesce(table.agg(F.max("id")).scalar(), F.lit(0))


def append_rows(
    target: DataFrame, new: DataFrame, order: list[str], now: Column | None = None,
    highest: Column | None = None,
) -> DataFrame:
    """Append rows with the next free ids, numbered in ``order`` (K1)."""
    now = utc_now() if now is None else now
    highest = next_id_after(target) if highest is None else highest
    numbered = number_rows(new, order, highest, "id", "append")
    return target.unionByName(as_catalogue(numbered, now))


def merge_candidates(mapped: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per merge key with the catalogue id it updates, or null.

    Of several mapped rows the last in feed order counts; of several catalogue rows the
    one with the highest id. Both are aggregates, so this join meets unique keys.
    """
    last = mapped.groupBy(*FULL_KEY).agg(
        F.max_by(F.struct(*MAPPED_VALUES), F.struct(*FEED_ORDER)).alias("new")
    )
    targets = catalogue.groupBy(*FULL_KEY).agg(
        F.max_by(F.struct("id", "level_1"), F.col("id")).alias("old")
    )
    joined = lookup(last, targets, {k: F.col(k) for k in FULL_KEY}, "old", hot=False)
    return joined.select(
        F.col("old.id").alias("id"), *FULL_KEY, F.col("new.*"),
        F.col("old.level_1").alias("level_1_before"),
    )


def has_full_key() -> Column:
    """Whether a row has the values the catalogue requires."""
    out = F.lit(True)
    for k in FULL_KEY:
        out = out & F.col(k).isNotNull()
    return out


def merge_summary(candidates: DataFrame) -> DataFrame:
    """Updates, creates, rejects, and the updated rows' former category state."""
    found = F.col("id").isNotNull()
    blank = is_blank(F.col("level_1_before"))
    return candidates.agg(
        F.count_if(found).alias("update_count"),
        F.count_if(~found & has_full_key()).alias("create_count"),
        F.count_if(~has_full_key()).alias("reject_count"),
        F.count_if(found & blank).alias("level_1_null_before"),
        F.count_if(found & ~blank).alias("level_1_not_null_before"),
    )


class Merge(NamedTuple):
    catalogue: DataFrame
    summary: DataFrame
    rejects: DataFrame  # rows whose key the catalogue cannot store


def merge_catalogue(
    catalogue: DataFrame, mapped: DataFrame, now: Column | None = None, bucketed: bool = False,
) -> Merge:
    """New catalogue version, merge summary and rejected rows.

    ``bucketed``: the catalogue is a table bucketed by the full key (``write_bucketed``). It is
    then updated by that key where it lies, and no row of it is shuffled. Otherwise it is
    updated by id, which moves each row once and has no hot key.
    """
    candidates = stage(merge_candidates(mapped, catalogue), "merge")
    updates = candidates.where(F.col("id").isNotNull())
    rest = candidates.where(F.col("id").isNull()).select(*RECORD)
    if bucketed:
        new = updates.select(*FULL_KEY, F.struct("id", *MAPPED_VALUES).alias("_upd"))
        joined = lookup(catalogue, new, {k: F.col(k) for k in FULL_KEY}, "_upd", hot=False)
        hit = F.col("_upd.id") == F.col("id")
        updated = put(joined, hit, {c: F.col(f"_upd.{c}") for c in MAPPED_VALUES}).drop("_upd")
    else:
        updated = bulk_update(catalogue, updates, "id", MAPPED_VALUES)
    merged = append_rows(
        updated.select(*CATALOGUE.names), rest.where(has_full_key()), FULL_KEY, now,
        next_id_after(catalogue),
    )
    return Merge(merged, merge_summary(candidates), rest.where(~has_full_key()))


def stamp_catalogue_from_feed(
    catalogue: DataFrame, sellers: DataFrame, insert_missing: bool = False,
    now: Column | None = None,
) -> DataFrame:
    """Set date and title of catalogue rows from the feed's latest.

    SKU and channel match without regard to case. ``insert_missing`` also appends the
    sellers that match no catalogue row.
    """
    sku, channel = fold_case(F.col("seller_sku")), fold_case(F.col("sales_channel"))
    latest = sellers.groupBy(sku.alias("sku"), channel.alias("channel")).agg(
        F.max(F.struct("date", "title")).alias("rec")
    )
    on = {"sku": fold_case(F.col("marketplace_sku")), "channel": channel}
    joined = lookup(catalogue, latest, on)
    values = {"date": datetime_text(F.col("rec.date")), "amazon_title": F.col("rec.title")}
    stamped = put(joined, F.col("rec").isNotNull(), values).drop("rec")
    if not insert_missing:
        return stamped
    known = (
        catalogue.groupBy(
            fold_case(F.col("marketplace_sku")).alias("sku"),
            fold_case(F.col("sales_channel")).alias("channel"),
        )
        .agg(F.count("*").alias("rec"))
    )
    missing = (
        lookup(sellers, known, {"sku": sku, "channel": channel})
        .where(F.col("rec").isNull())
        .select(
            F.col("seller_sku").alias("marketplace_sku"), "asin", "region",
            "sales_channel", datetime_text(F.col("date")).alias("date"),
            F.col("title").alias("amazon_title"),
        )
        .where(has_full_key())
    )
    order = [*FULL_KEY, "sales_channel"]
    return append_rows(stamped, missing, order, now, next_id_after(catalogue))

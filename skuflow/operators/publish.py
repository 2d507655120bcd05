"""Publish staged rows to the product hierarchy: upsert, unmap, consume.

Row by row, later keys would overwrite the parents earlier ones set. As sets: of all
staged parents of an internal SKU only the last in key order survives, and a staged row
keeps its own parent exactly when no later row of its internal SKU has one.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions import is_blank
from skuflow.operators.joins import among, fits, lookup, put
from skuflow.schemas import HIERARCHY, SKU_REGION, STAGING, STAGING_DEFAULTS
from skuflow.session import stage
from skuflow.sources.tables import conform

_VALUES = [c for c in HIERARCHY.names if c not in SKU_REGION]
_Widths = Mapping[str, int]  # column: longest value


def staging_last(staging: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per (SKU, region) the last non-null value of each column, and the row count.

    ``columns`` limits the result to what a caller needs. Rows without a key form no
    group; they stay staged.
    """
    keyed = staging.where(
        F.col("marketplace_sku").isNotNull() & F.col("region").isNotNull()
    )
    columns = columns or [c for c in STAGING.names if c not in SKU_REGION]
    last = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in columns
    ]
    return keyed.groupBy(*SKU_REGION).agg(*last, F.count("*").alias("n_rows"))


def with_action(last: DataFrame, widths: _Widths | None = None) -> DataFrame:
    """Add ``action``: skip, unmap, fail or upsert.

    ``fail`` are rows with a value longer than ``widths`` allows for its column: the widths
    of the caller's own target table. Without them any length is published.
    """
    too_long = F.lit(False)
    for c, width in (widths or {}).items():
        too_long = too_long | F.coalesce(F.length(c) > width, F.lit(False))
    missing = (
        is_blank(F.col("marketplace_sku")) | is_blank(F.col("region"))
        | is_blank(F.col("asin"))
    )
    action = (
        F.when(missing, "skip").when(is_blank(F.col("im_sku")), "unmap")
        .when(too_long, "fail").otherwise("upsert")
    )
    return last.withColumn("action", action)


def publish_actions(staged: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Action per key, whether the hierarchy holds it, and staged rows behind it.

    Of the hierarchy only the staged keys are grouped.
    """
    held = among(hierarchy.select(*SKU_REGION), staged, SKU_REGION)
    keys = held.groupBy(*SKU_REGION).agg(F.count("*").alias("held"))
    on = {k: F.col(k) for k in SKU_REGION}
    return lookup(staged, keys, on, "held", hot=False).select(
        *SKU_REGION, "action", F.col("held").isNotNull().alias("exists"), "n_rows"
    )


def publish_summary(staged: DataFrame) -> DataFrame:
    """Processed, skipped and failed keys (A10)."""
    action = F.col("action")
    return staged.agg(
        F.count_if(action.isin("upsert", "unmap")).alias("rows_upserted_or_unmapped"),
        F.count_if(action == "skip").alias("rows_skipped_due_to_missing_fields"),
        F.count_if(action == "fail").alias("rows_failed_upsert"),
    )


def _position() -> Column:
    return F.struct(*SKU_REGION)


def last_parent_per_im_sku(staged: DataFrame) -> DataFrame:
    """Per internal SKU its last staged non-blank parent and that row's position."""
    return (
        staged.where((F.col("action") == "upsert") & ~is_blank(F.col("parent_sku")))
        .groupBy("im_sku")
        .agg(F.max(F.struct(_position().alias("pos"), "parent_sku")).alias("last"))
    )


def resolve_parents(staged: DataFrame) -> DataFrame:
    """Staged rows with the parent they end up with."""
    on = {"im_sku": F.col("im_sku")}
    joined = lookup(staged, last_parent_per_im_sku(staged), on, "last")
    later = (F.col("action") == "upsert") & (_position() < F.col("last.pos"))
    return put(joined, F.coalesce(later, F.lit(False)), {
        "parent_sku": F.col("last.parent_sku")
    }).drop("last")


def propagate_parent_on_publish(hierarchy: DataFrame, staged: DataFrame) -> DataFrame:
    """Hierarchy rows take the last staged parent of their internal SKU."""
    last = stage(last_parent_per_im_sku(staged), "last-parents")
    joined = lookup(hierarchy, last, {"im_sku": F.col("im_sku")}, "last", small=fits(last))
    hit = F.col("last").isNotNull()
    return put(joined, hit, {"parent_sku": F.col("last.parent_sku")}).drop("last")


def unmap(hierarchy: DataFrame, staged: DataFrame) -> DataFrame:
    """Hierarchy without the keys staged with a blank internal SKU."""
    return among(hierarchy, staged.where(F.col("action") == "unmap"), SKU_REGION, keep=False)


def hierarchy_upsert(hierarchy: DataFrame, upserts: DataFrame) -> DataFrame:
    """Overwrite every row of a staged key, insert keys not held.

    ``upserts`` is read several times: stage it. A batch that fits a broadcast moves no
    hierarchy row, and only the hierarchy keys it meets are compared with it.
    """
    on = {k: F.col(k) for k in SKU_REGION}
    records = upserts.select(*SKU_REGION, F.struct(*_VALUES).alias("rec"))
    joined = lookup(hierarchy.select(*HIERARCHY.names), records, on, small=fits(records))
    values = {c: F.col(f"rec.{c}") for c in _VALUES}
    updated = put(joined, F.col("rec").isNotNull(), values).drop("rec")
    held = among(hierarchy.select(*SKU_REGION), upserts, SKU_REGION).distinct()
    inserts = upserts.select(*HIERARCHY.names).join(held, SKU_REGION, "left_anti")
    return updated.unionByName(inserts)


def consume_staging(staging: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged rows that stay: those of skipped, failed or missing keys."""
    done = staged.where(F.col("action").isin("upsert", "unmap")).select(*SKU_REGION)
    return staging.join(done, SKU_REGION, "left_anti")


class Published(NamedTuple):
    hierarchy: DataFrame
    staging: DataFrame
    actions: DataFrame
    summary: DataFrame


def publish(
    staging: DataFrame, hierarchy: DataFrame, widths: _Widths | None = None
) -> Published:
    """Publish everything staged (M9).

    Columns that the staging table does not have take their defaults (N10); a null in a column
    that it has stays null.
    """
    whole = conform(staging, STAGING, defaults=STAGING_DEFAULTS)
    staged = stage(with_action(staging_last(whole, _VALUES), widths), "staged")
    upserts = stage(resolve_parents(staged).where(F.col("action") == "upsert"), "upserts")
    kept = propagate_parent_on_publish(unmap(hierarchy, staged), staged)
    return Published(
        hierarchy=hierarchy_upsert(kept, upserts),
        staging=consume_staging(staging, staged),
        actions=publish_actions(staged, hierarchy),
        summary=publish_summary(staged),
    )

"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions import datetime_text
from skuflow.operators.explore import quality_metrics
from skuflow.operators.feeds import feed_latest
from skuflow.operators.mapping import (
    column_subset, enrich_and_fill, harmonise_im_sku, map_by_full_key, mapped_only,
    override_exact_and_alternate,
)
from skuflow.operators.merge import (
    Merge, append_rows, has_full_key, merge_catalogue, stamp_catalogue_from_feed,
)
from skuflow.schemas import EXPORT_COLUMN_NAMES, FULL_KEY
from skuflow.session import stage
from skuflow.sources.tables import POSITION, dashboard_rows, write_csv


def map_feed(feed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every seller of the feed, mapped and enriched.

    Harmonise, enrich, fill, override: the order matters, as overrides replace enriched
    values by catalogue values, nulls included.
    """
    mapped = column_subset(mapped_only(catalogue))
    rows = stage(map_by_full_key(feed_latest(feed), mapped), "mapped")
    filled = enrich_and_fill(harmonise_im_sku(rows))
    return override_exact_and_alternate(filled, mapped)


def new_mapping(
    feed: DataFrame, catalogue: DataFrame, now: Column | None = None, bucketed: bool = False,
) -> Merge:
    """Map the feed and merge it into the catalogue."""
    return merge_catalogue(catalogue, map_feed(feed, catalogue), now, bucketed)


def export_feed(feed: DataFrame, path: str) -> None:
    """The feed's sellers as CSV files, before they are mapped (K3)."""
    sellers = feed_latest(feed).withColumn("date", datetime_text(F.col("date")))
    write_csv(sellers.select(*[F.col(c).alias(n) for n, c in EXPORT_COLUMN_NAMES.items()]), path)


class Dump(NamedTuple):
    catalogue: DataFrame
    rejects: DataFrame  # CSV rows without a full key


def dump(
    catalogue: DataFrame, csv_rows: DataFrame, feed: DataFrame, now: Column | None = None
) -> Dump:
    """Append catalogue CSV rows, then stamp the feed's latest date and title.

    Rows read with their positions get their ids as they stand in the files, so of rows with
    one key the later line wins wherever the highest id does. Others are numbered by value.
    """
    by_value = [*FULL_KEY, *[c for c in csv_rows.columns if c not in FULL_KEY]]
    order = [POSITION] if POSITION in csv_rows.columns else by_value
    loaded = append_rows(catalogue, csv_rows.where(has_full_key()), order, now)
    return Dump(
        stamp_catalogue_from_feed(loaded, feed_latest(feed)),
        csv_rows.where(~has_full_key()),
    )


class Dashboard(NamedTuple):
    rows: DataFrame
    metrics: DataFrame


def dashboard(catalogue: DataFrame) -> Dashboard:
    """All rows as JSON records, and the quality metrics."""
    return Dashboard(dashboard_rows(catalogue), quality_metrics(catalogue))


"""Order feeds: union, clean, distinct sellers and each seller SKU's latest title."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.functions import fold_case, norm_key_sql
from skuflow.operators.joins import lookup
from skuflow.session import stage

SELLER = ["seller_sku", "asin", "region", "sales_channel"]

# Which orders count.
_SHIPPED = "Shipped"
_OFF_MARKET = "NON-AMAZON"


def combine_feeds(feeds: Mapping[str, DataFrame], distinct: bool = False) -> DataFrame:
    """Union of the regional feeds (U1); ``distinct`` gives the older set union."""
    union = reduce(DataFrame.unionByName, feeds.values())
    return union.distinct() if distinct else union


def shipped_amazon_filter(feed: DataFrame, fold_status: bool = False) -> DataFrame:
    """Shipped orders of the marketplace; a null channel is dropped.

    Written once above the union: Catalyst moves it next to every scan.
    """
    status = F.col("order_status")
    shipped = (
        fold_case(status) == _SHIPPED.lower() if fold_status else status == _SHIPPED
    )
    return feed.where(shipped & (norm_key_sql(F.col("sales_channel")) != _OFF_MARKET))


def feed_projection(feed: DataFrame) -> DataFrame:
    """Six feed columns with normalised SKU and channel."""
    return feed.select(
        norm_key_sql(F.col("seller_sku")).alias("seller_sku"),
        "asin",
        "region",
        norm_key_sql(F.col("sales_channel")).alias("sales_channel"),
        "purchase_date",
        "title",
    )


def raw_sellers(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct un-normalised sellers of shipped marketplace orders."""
    raw = {
        region: f.where(
            (F.col("order_status") == _SHIPPED) & (F.col("sales_channel") != "Non-Amazon")
        ).select(*SELLER)
        for region, f in feeds.items()
    }
    return combine_feeds(raw, distinct=True)


def clean_feed(feed: DataFrame) -> DataFrame:
    return feed_projection(shipped_amazon_filter(feed))


def distinct_sellers(clean: DataFrame) -> DataFrame:
    """Distinct (SKU, ASIN, region, channel) (A1)."""
    return clean.select(*SELLER).distinct()


def latest_title(clean: DataFrame) -> DataFrame:
    """Newest purchase per (SKU, channel), ties to the higher title."""
    newest = F.max(F.struct("purchase_date", "title")).alias("rec")
    return clean.groupBy("seller_sku", "sales_channel").agg(newest)


def attach_latest_title(sellers: DataFrame, latest: DataFrame) -> DataFrame:
    """Give sellers their latest date and title; null SKUs get none."""
    on = {"seller_sku": F.col("seller_sku"), "sales_channel": F.col("sales_channel")}
    return lookup(sellers, latest, on).select(
        *SELLER,
        F.col("rec.purchase_date").alias("date"),
        F.col("rec.title").alias("title"),
    )


def condense_feed(clean: DataFrame) -> DataFrame:
    """Newest purchase per seller and title, staged.

    The only pass over the raw orders. Its one buffer is a timestamp, so it runs as a
    hash aggregate with map-side combine; orders of one seller collapse before the
    shuffle. Both the sellers and the latest titles derive from the small result.
    """
    newest = F.max("purchase_date").alias("purchase_date")
    return stage(clean.groupBy(*SELLER, "title").agg(newest), "feed")


def feed_latest(feed: DataFrame) -> DataFrame:
    """Distinct sellers of the combined feed with their latest date and title."""
    condensed = condense_feed(clean_feed(feed))
    return attach_latest_title(distinct_sellers(condensed), latest_title(condensed))

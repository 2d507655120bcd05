"""Declared table schemas and the key column lists shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*specs: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "t": T.TimestampNTZType()}
    fields = []
    for spec in specs:
        name, _, kind = spec.partition(":")
        required = kind.endswith("!")
        fields.append(T.StructField(name, kinds[kind.rstrip("!") or "s"], not required))
    return T.StructType(fields)


# Timestamps carry no zone: the sources store wall-clock values.
FEED = _struct(
    "seller_sku", "asin", "region", "sales_channel", "purchase_date:t", "title",
    "order_status",
)

CATALOGUE = _struct(
    "id:l!", "date", "marketplace_sku:s!", "asin:s!", "im_sku", "region:s!",
    "sales_channel", "level_1", "linworks_title", "amazon_title", "parent_sku",
    "modified_by", "modified_by_finance", "modified_by_admin", "comment",
    "comment_by_finance", "created_at:t!", "updated_at:t!",
)

STAGING = _struct(
    "id:l!", "marketplace_sku:s!", "asin:s!", "im_sku", "parent_sku", "region:s!",
    "marketplace:s!", "level_1", "level_2", "level_3", "level_4", "level_5",
    "linworks_title", "marketplace_sales_table:s!", "channel:s!", "company:s!",
    "modified_by", "modified_by_finance", "modified_by_admin", "comment",
    "comment_by_finance", "created_at:t!", "updated_at:t!",
)

HIERARCHY = _struct(
    "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "marketplace",
    "level_1", "level_2", "level_3", "level_4", "level_5", "company",
    "marketplace_sales_table", "channel", "linworks_title",
)

EDITS = _struct(
    "edit_seq:l!", "id:l!", "marketplace_sku:s!", "asin:s!", "region:s!", "im_sku",
    "parent_sku", "sales_channel", "level_1", "linworks_title", "comment",
    "comment_by_finance", "modified_by", "modified_by_finance", "modified_by_admin",
)

FULL_KEY = ["marketplace_sku", "asin", "region"]
SKU_REGION = ["marketplace_sku", "region"]

# What a catalogue record contributes to a mapped feed row.
MAPPED_VALUES = [
    "im_sku", "sales_channel", "level_1", "parent_sku", "linworks_title",
    "modified_by", "comment", "date", "amazon_title",
]
RECORD = FULL_KEY + MAPPED_VALUES

# The feed row a record came from: a total order for "first", "last" and fills.
FEED_ORDER = ["marketplace_sku", "asin", "region", "feed_channel"]

ATTRIBUTIONS = ["modified_by", "modified_by_finance", "modified_by_admin"]

# Column names used by the order feeds, the catalogue CSV and the feed export.
FEED_COLUMN_NAMES = {
    "SellerSKU_Optimized": "seller_sku",
    "ASIN": "asin",
    "Region": "region",
    "SalesChannel_Optimized": "sales_channel",
    "PurchaseDate_Materialized": "purchase_date",
    "Title": "title",
    "OrderStatus_Optimized": "order_status",
}
CSV_COLUMN_NAMES = {
    "marketplace_sku": "marketplace_sku",
    "asin": "asin",
    "im_sku": "im_sku",
    "region": "region",
    "SalesChannel": "sales_channel",
    "level_1": "level_1",
    "Linnworks Title": "linworks_title",
    "linnwork's_sku_received_from": "modified_by",
    "Comment": "comment",
}
EXPORT_COLUMN_NAMES = {
    "SellerSKU": "seller_sku",
    "ASIN": "asin",
    "Region": "region",
    "SalesChannel": "sales_channel",
    "Date": "date",
    "Title": "title",
}
CSV_OPTIONAL = {"Comment"}

# Defaults of the staging and hierarchy tables.
DEFAULT_SALES_TABLE = "stg_tr_amazon_raw"
DEFAULT_CHANNEL = "Amazon"
DEFAULT_COMPANY = "RDX"
STAGING_DEFAULTS = {
    "marketplace_sales_table": DEFAULT_SALES_TABLE,
    "channel": DEFAULT_CHANNEL,
    "company": DEFAULT_COMPANY,
}

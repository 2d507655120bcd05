"""Map feed rows to catalogue records and fill what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions import (
    ALT_PREFIX, base_sku, datetime_text, is_blank, norm_key_py, plus_sku, strip,
    toggle_prefix,
)
from skuflow.operators.joins import dedupe_last, lookup, put
from skuflow.operators.ordered import fill_within, stage_by_range
from skuflow.schemas import FEED_ORDER, FULL_KEY, MAPPED_VALUES, RECORD, SKU_REGION
from skuflow.session import stage

_OVERRIDDEN = [
    "im_sku", "sales_channel", "level_1", "linworks_title", "parent_sku", "modified_by",
    "comment",
]
_STRIPPED = {"im_sku", "level_1", "linworks_title", "parent_sku"}


def mapped_only(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows that have an internal SKU."""
    return catalogue.where(F.col("im_sku").isNotNull() & (F.col("im_sku") != ""))


def column_subset(catalogue: DataFrame) -> DataFrame:
    """The twelve columns the mapping reads, and ``id`` for last-wins."""
    return catalogue.select("id", *RECORD)


def last_by_full_key(mapped: DataFrame) -> DataFrame:
    """Last catalogue record per (SKU, ASIN, region)."""
    return dedupe_last(mapped, FULL_KEY, MAPPED_VALUES, F.col("id"))


def map_by_full_key(sellers: DataFrame, mapped: DataFrame) -> DataFrame:
    """Every seller, with the catalogue values of its full key, nulls included.

    ``feed_channel`` keeps the seller's own channel: with the key it orders the rows.
    """
    rows = sellers.select(
        norm_key_py(F.col("seller_sku")).alias("marketplace_sku"),
        "asin",
        "region",
        F.col("sales_channel").alias("feed_channel"),
        datetime_text(F.col("date")).alias("_date"),
        F.col("title").alias("_title"),
    )
    # A full key has one row per channel here, so it cannot be hot.
    on = {k: F.col(k) for k in FULL_KEY}
    joined = lookup(rows, last_by_full_key(mapped), on, hot=False)
    hit = F.col("rec").isNotNull()
    own = {"sales_channel": "feed_channel", "date": "_date", "amazon_title": "_title"}
    values = []
    for c in MAPPED_VALUES:
        other = F.col(own[c]) if c in own else F.lit(None).cast("string")
        values.append(F.when(hit, F.col(f"rec.{c}")).otherwise(other).alias(c))
    return joined.select(*FULL_KEY, *values, "feed_channel")


def asin_base_stats(rows: DataFrame) -> DataFrame:
    """Per ASIN: distinct base SKUs, whether a plus occurs, non-empty values.

    Two steps: the first combines equal bases map-side, so the second sees each (ASIN,
    base) once whatever the ASIN's share of the rows.
    """
    im_sku = F.col("im_sku")
    pairs = (
        rows.where(F.col("asin").isNotNull())
        .groupBy("asin", base_sku(im_sku).alias("base"))
        .agg(
            F.count_if(im_sku.endswith("+")).alias("plus"),
            F.count_if(im_sku != "").alias("filled"),
        )
    )
    return pairs.groupBy("asin").agg(
        F.count("base").alias("n_bases"),
        F.max("base").alias("base"),
        (F.sum("plus") > 0).alias("plus"),
        F.sum("filled").alias("n_filled"),
    )


def harmonise_im_sku(rows: DataFrame) -> DataFrame:
    """Give an ASIN's rows its one internal SKU, with the plus if any row has it."""
    wanted = F.when(F.col("plus"), plus_sku(F.col("base"))).otherwise(F.col("base"))
    agreed = (
        asin_base_stats(rows)
        .where("n_filled > 0 and n_bases = 1")
        .select("asin", F.struct("base", wanted.alias("wanted")).alias("rec"))
    )
    im_sku = F.col("im_sku")
    takes = im_sku.isNull() | (im_sku == "") | (im_sku == F.col("rec.base"))
    joined = lookup(rows, agreed, {"asin": F.col("asin")})
    hit = F.col("rec").isNotNull() & takes
    return put(joined, hit, {"im_sku": F.col("rec.wanted")}).drop("rec")


def first_per_im_sku(rows: DataFrame) -> DataFrame:
    """First complete (level_1, linworks_title) per internal SKU in feed order (A4)."""
    complete = ~is_blank(F.col("im_sku"))
    for c in ("level_1", "linworks_title"):
        complete = complete & ~is_blank(F.col(c))
    first = F.min_by(F.struct("level_1", "linworks_title"), F.struct(*FEED_ORDER))
    return rows.where(complete).groupBy("im_sku").agg(first.alias("rec"))


def fill_blank(rows: DataFrame, rec: str, columns: list[str]) -> DataFrame:
    """Fill each blank column from ``rec`` on its own; without a hit keep it."""
    return rows.withColumns({
        c: F.when(is_blank(F.col(c)), F.coalesce(F.col(f"{rec}.{c}"), F.col(c)))
        .otherwise(F.col(c))
        for c in columns
    })


def enrich_from_im_sku(rows: DataFrame) -> DataFrame:
    """Fill category and title from the first complete row of the internal SKU."""
    rows = rows.withColumn("im_sku", strip(F.col("im_sku")))
    joined = lookup(rows, first_per_im_sku(rows), {"im_sku": F.col("im_sku")})
    return fill_blank(joined, "rec", ["level_1", "linworks_title"]).drop("rec")


def _by_im_sku(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in slices by internal SKU, and those without one, which have nothing to fill.

    Ranging reads its input twice, for the bounds and for the rows: hence a stage table
    below it, which those without a key are read from as well.
    """
    rows = stage(rows, "unfilled")
    keyed = F.col("im_sku").isNotNull()
    order = ["im_sku", *FEED_ORDER]
    return stage_by_range(rows.where(keyed), order, "by-im-sku"), rows.where(~keyed)


def fill_parent_by_im_sku(rows: DataFrame) -> DataFrame:
    """Strip parents, then forward- and back-fill them inside each internal SKU."""
    keyed, others = _by_im_sku(rows.withColumn("parent_sku", strip(F.col("parent_sku"))))
    filled = fill_within(keyed, "im_sku", "parent_sku", FEED_ORDER)
    return filled.select(*rows.columns).unionByName(others)


def enrich_and_fill(rows: DataFrame) -> DataFrame:
    """J7 and W2 over one staged copy; both work on the stripped internal SKU."""
    stripped = rows.withColumns({
        "im_sku": strip(F.col("im_sku")), "parent_sku": strip(F.col("parent_sku")),
    })
    sliced, others = _by_im_sku(stripped)
    filled = fill_within(sliced, "im_sku", "parent_sku", FEED_ORDER)
    joined = lookup(filled, first_per_im_sku(sliced), {"im_sku": F.col("im_sku")})
    enriched = fill_blank(joined, "rec", ["level_1", "linworks_title"])
    return enriched.select(*rows.columns).unionByName(others.select(*rows.columns))


def last_by_sku_region(mapped: DataFrame) -> DataFrame:
    """Last catalogue record per (SKU, region)."""
    return dedupe_last(mapped, SKU_REGION, _OVERRIDDEN, F.col("id"))


def _override(joined: DataFrame, rec: str) -> DataFrame:
    values = {
        c: strip(F.col(f"{rec}.{c}")) if c in _STRIPPED else F.col(f"{rec}.{c}")
        for c in _OVERRIDDEN
    }
    return put(joined, F.col(rec).isNotNull(), values).drop(rec)


def override_by_sku_region(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Overwrite seven columns with the record of (SKU, region), nulls included."""
    return _override(lookup(rows, records, {k: F.col(k) for k in SKU_REGION}), "rec")


def override_by_alternate_sku(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The same by the SKU with its prefix toggled."""
    on = {"marketplace_sku": toggle_prefix(F.col("marketplace_sku")), "region": F.col("region")}
    return _override(lookup(rows, records, on), "rec")


def _stem(sku: Column) -> Column:
    return F.when(sku.startswith(ALT_PREFIX), toggle_prefix(sku)).otherwise(sku)


def override_exact_and_alternate(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """J3 then J4 with one shuffle of the rows.

    A SKU and its alternate differ by the prefix only, so both records meet under the
    part after it. A prefixed record is also the plain one of its own full SKU.
    """
    sku = F.col("marketplace_sku")
    plain = mapped.select(sku.alias("stem"), "region", F.lit(False).alias("pre"), "id", *_OVERRIDDEN)
    prefixed = mapped.where(sku.startswith(ALT_PREFIX)).select(
        _stem(sku).alias("stem"), "region", F.lit(True).alias("pre"), "id", *_OVERRIDDEN
    )
    record = F.struct(*_OVERRIDDEN)
    pairs = (
        plain.unionByName(prefixed).groupBy("stem", "region")
        .agg(
            F.max_by(record, F.when(~F.col("pre"), F.col("id"))).alias("plain"),
            F.max_by(record, F.when(F.col("pre"), F.col("id"))).alias("prefixed"),
        )
        .select("stem", "region", F.struct("plain", "prefixed").alias("pair"))
    )
    joined = lookup(rows, pairs, {"stem": _stem(sku), "region": F.col("region")}, "pair")
    has_prefix = sku.startswith(ALT_PREFIX)
    plain_rec, prefixed_rec = F.col("pair.plain"), F.col("pair.prefixed")
    exact = F.when(has_prefix, prefixed_rec).otherwise(plain_rec)
    alternate = F.when(has_prefix, plain_rec).otherwise(prefixed_rec)
    winner = joined.withColumn("rec", F.coalesce(alternate, exact)).drop("pair")
    return _override(winner, "rec")

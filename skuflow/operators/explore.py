"""Quality metrics, search, facets, drill-down and paging over a table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions import fold_case
from skuflow.operators.ordered import PLACE, SLICE, stage_in_order
from skuflow.session import stage

# Columns the listings show, search and filter by.
CATALOGUE_LIST = [
    "id", "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "sales_channel",
    "level_1", "linworks_title", "modified_by", "created_at", "updated_at",
]
CATALOGUE_SEARCH = [
    "marketplace_sku", "asin", "im_sku", "region", "parent_sku", "sales_channel", "level_1",
]
CATALOGUE_FACETS = ["region", "sales_channel"]
STAGING_LIST = [
    "id", "marketplace_sku", "asin", "im_sku", "region", "marketplace", "level_1",
    "level_2", "level_3", "level_4", "level_5", "parent_sku", "marketplace_sales_table",
    "channel", "company", "created_at", "updated_at",
]
STAGING_SEARCH = [
    "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "marketplace", "company",
]
STAGING_FACETS = ["region", "marketplace", "channel", "company"]
PAGE_SIZE = 25

_NULLS = {
    "null_im_sku": "im_sku",
    "null_parent_sku": "parent_sku",
    "lin_category_to_be_mapped": "level_1",
    "lin_title_to_be_mapped": "linworks_title",
}
_UNIQUES = {
    "unique_im_sku": "im_sku",
    "unique_marketplace_sku": "marketplace_sku",
    "unique_parent_sku": "parent_sku",
    "unique_regions": "region",
}


def quality_metrics(catalogue: DataFrame, approximate: bool = False) -> DataFrame:
    """Eight metrics in one row.

    Each distinct count is an aggregate of its own over one column, which combines before the
    shuffle; counted together, every row would be copied once for each of them. With
    ``approximate`` all come from sketches in one pass (``metric_sketches``).
    """
    if approximate:
        return sketched_metrics(metric_sketches(catalogue))
    nulls = catalogue.agg(
        *[F.count_if(F.col(c).isNull()).alias(n) for n, c in _NULLS.items()]
    )
    return nulls.select("*", *[
        catalogue.select(c).distinct().agg(F.count(c)).scalar().alias(n)
        for n, c in _UNIQUES.items()
    ])


def metric_sketches(catalogue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Null counts and distinct-value sketches per group of ``by``, to be stored (A2, A3).

    Rows of this table add up: those of new catalogue rows are appended to it, and
    ``sketched_metrics`` merges any of them without reading the catalogue. A sketch takes at
    most 4 KB, however many values it has seen.
    """
    return catalogue.groupBy(*by).agg(
        *[F.count_if(F.col(c).isNull()).alias(n) for n, c in _NULLS.items()],
        # A sketch passes over empty texts, so each value gets a letter before it.
        *[F.hll_sketch_agg(F.concat(F.lit("="), c)).alias(n) for n, c in _UNIQUES.items()],
    )


def sketched_metrics(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics of stored sketches, merged per group of ``by`` (A2, A3).

    Distinct counts are estimates with a standard error of 1.6 %; null counts are exact.
    No sketches at all give zeros.
    """
    def merged(name: str) -> Column:
        return F.hll_sketch_estimate(F.hll_union_agg(name))

    return sketches.groupBy(*by).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _NULLS],
        *[F.coalesce(merged(n), F.lit(0)).alias(n) for n in _UNIQUES],
    )


def _terms(text: str) -> list[str]:
    """Words of a search text; a quoted phrase is one word."""
    return [a or b or c for a, b, c in re.findall(r'"([^"]+)"|\'([^\']+)\'|(\S+)', text)]


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows where every word occurs in some column, without regard to case."""
    def anywhere(word: str) -> Column:
        return reduce(
            Column.__or__,
            [F.coalesce(fold_case(F.col(c)).contains(word.lower()), F.lit(False)) for c in columns],
        )
    return reduce(lambda d, word: d.where(anywhere(word)), _terms(text), df)


GRAM = 3  # letters of a gram
_GRAM, _BLOCK, _ROWS = "_gram", "_block", "_rows"
_BITS = 64  # rows of a block: a bit of a long for each


class SearchIndex(NamedTuple):
    rows: DataFrame  # in slices by id, each with its place in the slice
    postings: DataFrame  # in order: each gram with the slices, blocks and places of its rows
    columns: tuple[str, ...]  # what the index covers


def search_index(df: DataFrame, columns: Sequence[str], key: str = "id") -> SearchIndex:
    """Index the texts of ``columns`` so that a search opens candidate rows only.

    A gram starts at every letter of a value and has ``GRAM`` letters, fewer at its end. So a
    word of ``GRAM`` letters or more occurs only in rows that hold all of its grams, and a
    shorter one only in rows with a gram that begins with it. Rows lie in the order of ``key``
    and are told apart by their places. A posting is a gram's rows among ``_BITS`` that follow
    each other, a bit each: tasks join them before the shuffle, so a frequent gram is one row
    a block. Postings are sorted by gram and block, so a frequent gram spreads over many files
    and a search reads the parts with its grams.
    """
    rows = stage_in_order(df, [F.col(key)], "search-rows")
    def grams(text: Column) -> Column:
        starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
        cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))
        return F.coalesce(cut, F.array().cast("array<string>"))

    found = F.concat(*[grams(fold_case(F.col(c))) for c in columns])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(PLACE) % _BITS).cast("int"))
    postings = (
        rows.select(SLICE, _block().alias(_BLOCK), bit.alias(_ROWS), F.explode(found).alias(_GRAM))
        .groupBy(_GRAM, SLICE, _BLOCK).agg(F.bit_or(_ROWS).alias(_ROWS))
    )
    order = [_GRAM, SLICE, _BLOCK]
    ordered = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    return SearchIndex(rows, stage(ordered, "search-grams"), tuple(columns))


def _block() -> Column:
    return F.floor(F.col(PLACE) / _BITS)


def indexed_search(index: SearchIndex, text: str) -> DataFrame:
    """``search`` by an index: the rows that hold every gram of every word, then verified.

    Only the slices with a candidate are opened; their numbers, one row a slice, are broadcast.
    """
    rows = index.rows.drop(SLICE, PLACE)
    words = [w.lower() for w in _terms(text)]
    if not words:
        return rows
    wanted = sorted({w[i:i + GRAM] for w in words for i in range(len(w) - GRAM + 1)})
    short = sorted({w for w in words if len(w) < GRAM})
    gram = F.col(_GRAM)
    hits = [gram == g for g in wanted] + [gram.startswith(w) for w in short]
    in_all = reduce(Column.bitwiseAND, [F.col(f"_hit{i}") for i in range(len(hits))])
    candidates = (
        index.postings.where(reduce(Column.__or__, hits)).groupBy(SLICE, _BLOCK)
        .agg(*[F.bit_or(F.when(hit, F.col(_ROWS))).alias(f"_hit{i}") for i, hit in enumerate(hits)])
        .select(F.col(SLICE).alias("_at"), _BLOCK, in_all.alias(_ROWS)).where(F.col(_ROWS) != 0)
    )
    slices = F.broadcast(candidates.select(F.col("_at").alias(SLICE)).distinct())
    opened = index.rows.join(slices, SLICE, "left_semi")
    same = (
        (F.col(SLICE) == F.col("_at")) & (_block() == F.col(_BLOCK))
        & (F.getbit(F.col(_ROWS), F.col(PLACE) % _BITS) == 1)
    )
    return search(opened.join(candidates, same, "left_semi").drop(SLICE, PLACE), text, index.columns)


def facet_counts(df: DataFrame, column: str) -> DataFrame:
    """Values of a column with their row counts."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def facet_filter(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows equal to every given value; None selects nulls."""
    for column, value in values.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df


def date_facet_filter(df: DataFrame, column: str, choice: str, today: Column) -> DataFrame:
    """Rows of today, the past 7 days, this month or this year."""
    tomorrow = F.date_add(today, 1)
    month, year = F.trunc(today, "month"), F.trunc(today, "year")
    bounds = {
        "today": (today, tomorrow),
        "past_7_days": (F.date_sub(today, 7), tomorrow),
        "this_month": (month, F.add_months(month, 1)),
        "this_year": (year, F.add_months(year, 12)),
    }
    low, high = (d.cast("timestamp_ntz") for d in bounds[choice])
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def date_drilldown(df: DataFrame, column: str, level: str) -> DataFrame:
    """Row counts per year, month or day."""
    day = F.col(column).cast("date")
    period = day if level == "day" else F.trunc(day, level)
    return df.groupBy(period.cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("n"))


def list_view(df: DataFrame, columns: Sequence[str] = tuple(CATALOGUE_LIST)) -> DataFrame:
    """The listed columns (E5)."""
    return df.select(*columns)


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def list_page(df: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a listing, newest first, ties by descending id (L4)."""
    return df.orderBy(*_newest_first()).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, created_at: Column, id_: Column, size: int = PAGE_SIZE) -> DataFrame:
    """The rows that follow the given one in a listing (L4): as cheap for late pages as for
    the first, since a task keeps ``size`` rows at most."""
    at = F.col("created_at")
    later = (at < created_at) | ((at == created_at) & (F.col("id") < id_))
    return df.where(later).orderBy(*_newest_first()).limit(size)


class PageIndex(NamedTuple):
    rows: DataFrame  # in slices of the listing's order, each with its place in the slice
    slices: DataFrame  # per slice: its rows and the rows before it


def page_index(df: DataFrame) -> PageIndex:
    """Put a listing in order once, so that any page can be read by itself (L4)."""
    rows = stage_in_order(df, _newest_first(), "pages")
    counts = rows.groupBy(SLICE).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(SLICE)) - F.col("n")  # a row for each slice
    return PageIndex(rows, stage(counts.withColumn("before", before), "page-slices"))


def indexed_page(index: PageIndex, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of an indexed listing (L4): ``list_page`` without sorting or skipping rows.

    Only the slices the page touches are read, ``size`` at most; a page behind the end is empty.
    """
    first, end = (page - 1) * size, page * size
    touched = index.slices.where((F.col("before") < end) & (F.col("before") + F.col("n") > first))
    wanted = F.lit(False)
    for s in touched.collect():
        places = F.col(PLACE).between(first - s["before"], end - 1 - s["before"])
        wanted = wanted | ((F.col(SLICE) == s[SLICE]) & places)
    rows = index.rows.where(wanted).orderBy(SLICE, PLACE)
    return rows.drop(SLICE, PLACE)


def sample_head(df: DataFrame, n: int, order: Sequence[str], present: str = "level_1") -> DataFrame:
    """First ``n`` rows in ``order`` that have a value (L3)."""
    return df.where(F.col(present).isNotNull()).orderBy(*order).limit(n)


def match_count(catalogue: DataFrame, im_sku: str) -> DataFrame:
    """Rows with an internal SKU, without regard to case."""
    hit = fold_case(F.col("im_sku")) == im_sku.lower()
    return catalogue.agg(F.count_if(hit).alias("n"))

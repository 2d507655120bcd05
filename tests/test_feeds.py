from __future__ import annotations

from datetime import datetime

from skuflow import schemas as S
from skuflow.operators import feeds as D
from skuflow.sources.tables import read_feeds
from tests.helpers import frame, pick

DAY1, DAY2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def _feed(spark, rows):
    base = {
        "seller_sku": "S", "asin": "A", "region": "DE", "sales_channel": "Amazon.de",
        "purchase_date": DAY1, "title": "t", "order_status": "Shipped",
    }
    return frame(spark, S.FEED, [{**base, **r} for r in rows])


def test_filter_drops_pending_off_market_and_null_channel(spark):
    feed = _feed(spark, [
        {"title": "keep"}, {"order_status": "Pending"}, {"sales_channel": " non-amazon "},
        {"sales_channel": None}, {"order_status": "shipped", "title": "folded"},
        {"order_status": None},
    ])
    assert pick(D.clean_feed(feed), "title") == [("keep",)]
    folded = D.feed_projection(D.shipped_amazon_filter(feed, fold_status=True))
    assert pick(folded, "title") == [("folded",), ("keep",)]


def test_latest_title_per_sku_and_channel(spark):
    feed = _feed(spark, [
        {"seller_sku": " s ", "title": "old"},
        {"seller_sku": "S", "purchase_date": DAY2, "title": "new", "asin": "B"},
        {"seller_sku": "S", "purchase_date": DAY2, "title": "newer", "asin": "C"},
        {"seller_sku": "S", "purchase_date": None, "title": "zzz"},
        {"seller_sku": "S", "sales_channel": "amazon.it", "title": "it"},
        {"seller_sku": None, "title": "nobody"},
        {"seller_sku": "N", "purchase_date": None, "title": "undated"},
    ])
    got = pick(D.feed_latest(feed), "seller_sku", "asin", "sales_channel", "date", "title")
    assert got == [
        (None, "A", "AMAZON.DE", None, None),
        ("N", "A", "AMAZON.DE", None, "undated"),
        ("S", "A", "AMAZON.DE", DAY2, "newer"),
        ("S", "A", "AMAZON.IT", DAY1, "it"),
        ("S", "B", "AMAZON.DE", DAY2, "newer"),
        ("S", "C", "AMAZON.DE", DAY2, "newer"),
    ]


def test_union_and_distinct_union(spark):
    feeds = {"DE": _feed(spark, [{}, {}]), "IT": _feed(spark, [{}, {"region": "IT"}])}
    assert D.combine_feeds(feeds).count() == 4
    assert D.combine_feeds(feeds, distinct=True).count() == 2
    assert pick(D.raw_sellers(feeds), "seller_sku", "region") == [("S", "DE"), ("S", "IT")]


def test_read_feeds_renames_external_columns(spark, tmp_path):
    external = {v: k for k, v in S.FEED_COLUMN_NAMES.items()}
    path = str(tmp_path / "de")
    _feed(spark, [{}]).withColumnsRenamed(external).write.parquet(path)
    feeds = read_feeds(spark, {"DE": path, "IT": _feed(spark, [{"region": "IT"}])})
    assert feeds["DE"].columns == S.FEED.names
    assert D.combine_feeds(feeds).count() == 2


def test_filter_is_pushed_below_the_union(spark, tmp_path):
    paths = {r: str(tmp_path / r) for r in ("DE", "IT")}
    for path in paths.values():
        _feed(spark, [{}]).write.parquet(path)
    clean = D.clean_feed(D.combine_feeds(read_feeds(spark, paths)))
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(order_status,Shipped)") == 2
    sellers = D.distinct_sellers(clean)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in sellers.splitlines() if "ReadSchema" in line]
    assert len(schemas) == 2 and not any("title" in s.split("ReadSchema")[1] for s in schemas)

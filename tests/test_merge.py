from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skuflow.operators import merge as G
from skuflow.operators.joins import bulk_update
from skuflow.operators.ordered import number_rows
from skuflow.plans.jobs import dump
from skuflow.schemas import CATALOGUE, FEED, FULL_KEY
from skuflow.sources.tables import write_bucketed
from tests.helpers import NOW, OLD, catalogue, frame, mapped, pick


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_merge_updates_last_row_and_inserts(spark):
    cat = catalogue(spark, [
        {"id": 1, "level_1": "keep", "modified_by_finance": "fin"},
        {"id": 5, "level_1": " ", "modified_by_finance": "fin", "comment_by_finance": "c"},
        {"id": 7, "marketplace_sku": "other", "level_1": "x"},
    ])
    rows = mapped(spark, [
        {"level_1": "a", "feed_channel": "C1"}, {"level_1": "b", "feed_channel": "C2"},
        {"marketplace_sku": "N2", "level_1": "n2"}, {"marketplace_sku": "N1", "level_1": "n1"},
        {"marketplace_sku": "N1", "level_1": "n1 last", "feed_channel": "D"},
        {"marketplace_sku": None, "level_1": "lost"},
    ])
    result = G.merge_catalogue(cat, rows, _now())
    assert result.catalogue.columns == CATALOGUE.names
    got = pick(result.catalogue, "id", "marketplace_sku", "level_1", "modified_by_finance", "created_at", "updated_at")
    assert sorted(got) == [
        (1, "S", "keep", "fin", OLD, OLD), (5, "S", "b", "fin", OLD, OLD),
        (7, "other", "x", None, OLD, OLD), (8, "N1", "n1 last", None, NOW, NOW),
        (9, "N2", "n2", None, NOW, NOW),
    ]
    assert pick(result.rejects, "level_1") == [("lost",)]
    assert pick(result.summary, *result.summary.columns) == [(1, 2, 1, 1, 0)]
    again = G.merge_catalogue(result.catalogue, rows, _now())
    assert pick(again.catalogue, *CATALOGUE.names) == pick(result.catalogue, *CATALOGUE.names)


def test_bucketed_catalogue_is_not_shuffled(spark, conf, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    plain = catalogue(spark, [
        {"id": i, "marketplace_sku": f"S{i // 2}", "level_1": "old" if i % 3 else None} for i in range(1, 60)
    ])
    rows = mapped(spark, [
        {"marketplace_sku": f"S{i}", "level_1": None if i % 4 else "new", "feed_channel": c}
        for i in range(20, 40) for c in "CD"
    ] + [{"marketplace_sku": None}])
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    held = write_bucketed(plain, "held_in_buckets", str(tmp_path / "held"), FULL_KEY, 4)
    try:
        got, want = G.merge_catalogue(held, rows, _now(), bucketed=True), G.merge_catalogue(plain, rows, _now())
        for a, b in zip(got, want):
            assert pick(a, *a.columns) == pick(b, *a.columns)
        plan = got.catalogue._jdf.queryExecution().executedPlan().toString()
        wide = [line for line in plan.splitlines() if "FileScan" in line and "held_in_buckets" in line and "Bucketed: true" in line]
        assert wide
        _, _, below = plan.partition("SortMergeJoin")
        left = below.split("FileScan")[0]
        assert "Exchange" not in left
        _, _, below = G.merge_candidates(rows, held)._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")
        assert below.count("Exchange hashpartitioning") == 1  # of the mapped rows
    finally:
        spark.sql("drop table held_in_buckets")


def test_merge_into_empty_catalogue(spark):
    result = G.merge_catalogue(catalogue(spark, []), mapped(spark, [{}]), _now())
    assert pick(result.catalogue, "id", "marketplace_sku") == [(1, "S")]


def test_number_rows_is_dense_across_slices(spark, many_slices):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    numbered = number_rows(df.repartition(5), ["k"], F.lit(41), "n", "numbers")
    assert sorted((r.k, r.n) for r in numbered.collect()) == [(f"k{i:04d}", 42 + i) for i in range(1000)]


def test_bulk_update_writes_nulls(spark):
    target = catalogue(spark, [{"id": 1, "level_1": "a", "comment": "c"}, {"id": 2, "level_1": "b"}])
    updates = spark.createDataFrame([(1, None), (9, "z")], "id long, level_1 string")
    assert pick(bulk_update(target, updates, "id", ["level_1"]), "id", "level_1", "comment") == [
        (1, None, "c"), (2, "b", None),
    ]


def test_stamp_ignores_case_and_writes_nulls(spark):
    cat = catalogue(spark, [
        {"id": 1, "marketplace_sku": "s", "sales_channel": "Amazon.DE", "date": "x", "amazon_title": "y"},
        {"id": 2, "marketplace_sku": "S", "sales_channel": "amazon.de"},
        {"id": 3, "marketplace_sku": "S", "sales_channel": None, "date": "keep"},
        {"id": 4, "marketplace_sku": "Z", "sales_channel": "amazon.de", "date": "old", "amazon_title": "old"},
    ])
    day = datetime(2024, 2, 3)
    sellers = spark.createDataFrame(
        [("S", "A", "DE", "AMAZON.DE", day, "t"), ("S", "B", "DE", "AMAZON.DE", day, "t"),
         ("Z", "A", "DE", "AMAZON.DE", None, None), ("NEW", "A", "DE", "AMAZON.DE", day, "n")],
        "seller_sku string, asin string, region string, sales_channel string, date timestamp_ntz, title string",
    )
    stamped = G.stamp_catalogue_from_feed(cat, sellers)
    expected = [
        (1, "2024-02-03 00:00:00", "t"), (2, "2024-02-03 00:00:00", "t"),
        (3, "keep", None), (4, None, None),
    ]
    assert pick(stamped, "id", "date", "amazon_title") == expected
    more = G.stamp_catalogue_from_feed(cat, sellers, insert_missing=True, now=_now())
    assert pick(more, "id", "date", "amazon_title") == expected + [(5, "2024-02-03 00:00:00", "n")]


def test_dump_rejects_rows_without_a_key(spark):
    rows = spark.createDataFrame(
        [("S9", "A", "DE", "l"), (None, "A", "DE", "lost")],
        "marketplace_sku string, asin string, region string, level_1 string",
    )
    feed = frame(spark, FEED, [{
        "seller_sku": "s9", "asin": "A", "region": "DE", "sales_channel": "x",
        "order_status": "Shipped", "title": "t",
    }])
    done = dump(catalogue(spark, [{"id": 3}]), rows, feed, _now())
    assert pick(done.catalogue, "id", "marketplace_sku", "level_1", "created_at") == [
        (3, "S", None, OLD), (4, "S9", "l", NOW),
    ]
    assert pick(done.rejects, "level_1") == [("lost",)]

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skuflow.operators import explore as X
from tests.helpers import catalogue, pick


@pytest.fixture(scope="module")
def table(spark):
    return catalogue(spark, [
        {"id": 1, "im_sku": "IM1", "region": "DE", "level_1": "Gym Mats", "created_at": datetime(2024, 6, 1, 5)},
        {"id": 2, "im_sku": "", "region": "IT", "level_1": "", "created_at": datetime(2024, 5, 25)},
        {"id": 3, "im_sku": None, "region": "DE", "sales_channel": "Amazon.de", "created_at": datetime(2024, 5, 24, 23)},
        {"id": 4, "im_sku": "im1", "region": "DE", "parent_sku": "50%_x", "created_at": datetime(2023, 12, 31)},
    ])


def test_metrics(table):
    row = X.quality_metrics(table).first().asDict()
    assert row == {
        "null_im_sku": 1, "null_parent_sku": 3, "lin_category_to_be_mapped": 2,
        "lin_title_to_be_mapped": 4, "unique_im_sku": 3, "unique_marketplace_sku": 1,
        "unique_parent_sku": 1, "unique_regions": 2,
    }
    assert X.quality_metrics(table, approximate=True).first().asDict() == row


@pytest.mark.parametrize("text, ids", [
    ("im1", [1, 4]), ("de amazon", [3]), ("IM1 gym", [1]), ('"gym mats"', [1]),
    ('"mats gym"', []), ("50%", [4]), ("", [1, 2, 3, 4]), ("%", [4]),
])
def test_search(table, text, ids):
    assert pick(X.search(table, text, X.CATALOGUE_SEARCH), "id") == [(i,) for i in ids]


def test_facets(table):
    assert pick(X.facet_counts(table, "sales_channel"), "value", "n") == [(None, 3), ("Amazon.de", 1)]
    assert pick(X.facet_filter(table, region="DE", sales_channel=None), "id") == [(1,), (4,)]


@pytest.mark.parametrize("choice, ids", [
    ("today", [1]), ("past_7_days", [1, 2]), ("this_month", [1]), ("this_year", [1, 2, 3]),
])
def test_date_facet(table, choice, ids):
    today = F.lit("2024-06-01").cast("date")
    assert pick(X.date_facet_filter(table, "created_at", choice, today), "id") == [(i,) for i in ids]


def test_drilldown_and_pages(table):
    assert pick(X.date_drilldown(table, "created_at", "year"), "period", "n") == [
        (datetime(2023, 1, 1), 1), (datetime(2024, 1, 1), 3),
    ]
    assert [r.id for r in X.list_page(table, 1, 3).collect()] == [1, 2, 3]
    assert [r.id for r in X.list_page(table, 2, 3).collect()] == [4]
    assert X.list_view(table).columns == X.CATALOGUE_LIST
    assert pick(X.sample_head(table, 1, ["id"]), "id") == [(1,)]
    assert X.match_count(table, "Im1").first().n == 2


def test_pages_of_an_index(spark, many_slices):
    # Creation times repeat, so bounds of slices and pages fall between equal ones.
    listed = catalogue(spark, [
        {"id": i, "marketplace_sku": f"S{i}", "created_at": datetime(2024, 1, 1 + i * 7 % 5)} for i in range(1, 501)
    ]).repartition(7)
    index = X.page_index(listed)
    assert index.slices.count() > 1
    for page, size in ((1, 25), (2, 25), (11, 25), (20, 25), (3, 200), (1, 1000), (501, 1), (21, 25)):
        got, want = X.indexed_page(index, page, size), X.list_page(listed, page, size)
        assert got.columns == listed.columns
        assert got.collect() == want.collect()
    # Nothing but the rows' folder and place is asked of the scan, and few files answer.
    assert len(X.indexed_page(index, 11, 5).inputFiles()) <= len(index.rows.inputFiles())
    plan = X.indexed_page(index, 11, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_place" in plan.split("PushedFilters")[1]


def test_pages_that_follow_a_row(spark):
    listed = catalogue(spark, [
        {"id": i, "created_at": datetime(2024, 1, 1 + i * 7 % 5)} for i in range(1, 101)
    ])
    seen, last = [], None
    while True:
        page = (
            X.list_page(listed, 1, 30) if last is None
            else X.page_after(listed, F.lit(last.created_at).cast("timestamp_ntz"), F.lit(last.id), 30)
        ).collect()
        if not page:
            break
        seen, last = seen + page, page[-1]
    assert seen == X.list_page(listed, 1, 1000).collect() and len(seen) == 100


def test_pages_of_nothing(spark):
    index = X.page_index(catalogue(spark, []))
    assert X.indexed_page(index).collect() == []


def test_exact_counts_copy_no_rows(table):
    plan = X.quality_metrics(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_sketches_add_up(spark):
    rows = [
        {"id": i, "im_sku": f"IM{i % 90}" if i % 4 else None, "marketplace_sku": f"S{i}",
         "region": "DE" if i % 3 else "IT", "level_1": None if i % 5 else "L"}
        for i in range(2000)
    ]
    whole = X.quality_metrics(catalogue(spark, rows)).first().asDict()
    old, new = (X.metric_sketches(catalogue(spark, part), ["region"]) for part in (rows[:700], rows[700:]))
    stored = old.unionByName(new)
    got = X.sketched_metrics(stored).first().asDict()
    for name, value in whole.items():
        assert got[name] == pytest.approx(value, rel=0.05), name
    by_region = X.sketched_metrics(stored, ["region"])
    assert pick(by_region, "region", "null_im_sku") == [("DE", 333), ("IT", 167)]
    nothing = X.sketched_metrics(X.metric_sketches(catalogue(spark, []), ["region"])).first()
    assert set(nothing.asDict().values()) == {0}


SEARCHES = [
    "a", "9", "s1", "S12", "amazon", "amazon.d", "de s3", '"gym mats"', "ats g", "50%_x", "%", "ßa", "x y z",
    "nothing", "s123 s12", "", "\u00e4", "İ",
]


def test_index_finds_what_the_scan_finds(spark, many_slices):
    texts = ["Gym Mats", "mats gym", "50%_X", None, "", "ÄPFEL", "ßa", "aaaa", "İzmir", "x"]
    table = catalogue(spark, [
        {"id": i, "marketplace_sku": f"S{i % 150}", "level_1": texts[i % 10], "region": ["DE", "IT"][i % 2],
         "sales_channel": "Amazon.de" if i % 3 else None}
        for i in range(300)
    ])
    index = X.search_index(table, X.CATALOGUE_SEARCH)
    for text in SEARCHES:
        got, want = X.indexed_search(index, text), X.search(table, text, X.CATALOGUE_SEARCH)
        assert got.columns == want.columns
        assert pick(got, "id") == pick(want, "id"), text


def test_index_of_rows_with_one_key(spark):
    table = catalogue(spark, [{"id": 1, "level_1": "mat"}, {"id": 1, "level_1": "bar"}, {"id": None, "level_1": "mat"}])
    index = X.search_index(table, ["level_1"])
    assert pick(X.indexed_search(index, "mat"), "id") == [(None,), (1,)]
    empty = X.search_index(catalogue(spark, []), ["level_1"])
    assert X.indexed_search(empty, "mat").count() == 0


def test_indexed_search_prunes(spark, conf):
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="8")
    table = catalogue(spark, [{"id": i, "marketplace_sku": f"S{i:04d}"} for i in range(800)])
    found = X.indexed_search(X.search_index(table, ["marketplace_sku"]), "s0007")
    assert pick(found, "id") == [(7,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [In(_gram" in plan


def test_frequent_gram_is_a_row_a_block(spark, conf):
    conf(spark__sql__shuffle__partitions="4", spark__sql__adaptive__coalescePartitions__enabled="false")
    table = catalogue(spark, [{"id": i, "marketplace_sku": f"S{i % 3}", "region": "everywhere"} for i in range(1280)])
    index = X.search_index(table, ["marketplace_sku", "region"])
    # 20 full blocks, and one begun at each slice's end.
    assert index.postings.where("_gram = 'eve'").count() <= 24
    found = X.indexed_search(index, "where S2").select("id").collect()
    assert sorted(r.id for r in found) == list(range(2, 1280, 3))

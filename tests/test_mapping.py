from __future__ import annotations

import random
from datetime import datetime

import pandas as pd
import pytest

from skuflow.operators import mapping as M
from skuflow.schemas import FEED_ORDER, RECORD
from tests.helpers import catalogue, mapped, pick


def _sellers(spark, rows):
    return spark.createDataFrame(
        rows,
        "seller_sku string, asin string, region string, sales_channel string, "
        "date timestamp_ntz, title string",
    )


def test_full_key_hit_takes_nulls_and_last_id(spark):
    cat = catalogue(spark, [
        {"id": 1, "im_sku": "IM1", "level_1": "old", "amazon_title": "x"},
        {"id": 2, "im_sku": "IM2", "sales_channel": "ch"},
        {"id": 3, "im_sku": ""},
    ])
    day = datetime(2024, 5, 5, 1, 2, 3)
    sellers = _sellers(spark, [
        ("\ts ", "A", "DE", "C1", day, "t1"), ("S", "A", "IT", "C1", day, "t2"),
        (None, "A", "DE", "C1", None, None),
    ])
    rows = M.map_by_full_key(sellers, M.column_subset(M.mapped_only(cat)))
    got = pick(rows, "marketplace_sku", "region", "im_sku", "sales_channel", "level_1", "date", "amazon_title", "feed_channel")
    assert got == [
        (None, "DE", None, "C1", None, None, None, "C1"),
        ("S", "DE", "IM2", "ch", None, None, None, "C1"),
        ("S", "IT", None, "C1", None, "2024-05-05 01:02:03", "t2", "C1"),
    ]


@pytest.mark.parametrize("before, after", [
    ([None, "", None], [None, "", None]),
    (["X", None, "X"], ["X", "X", "X"]),
    (["X", "X+", None], ["X+", "X+", "X+"]),
    (["", "X", "X+"], ["", "X", "X+"]),
    (["X", "Y", None], ["X", "Y", None]),
    (["A++", None], ["A++", "A++"]),
    (["A+", "A++"], ["A+", "A++"]),
    ([" ", None], [" ", " "]),
])
def test_harmonise(spark, before, after):
    rows = [{"marketplace_sku": str(i), "im_sku": v} for i, v in enumerate(before)]
    other = [{"marketplace_sku": f"z{i}", "asin": "B", "im_sku": v} for i, v in enumerate(["Q", None])]
    lost = [{"marketplace_sku": f"n{i}", "asin": None, "im_sku": v} for i, v in enumerate(["Q", None])]
    got = pick(M.harmonise_im_sku(mapped(spark, rows + other + lost)), "marketplace_sku", "im_sku")
    expected = [(str(i), v) for i, v in enumerate(after)]
    assert got == expected + [("n0", "Q"), ("n1", None), ("z0", "Q"), ("z1", "Q")]


def test_enrich_fills_each_blank_on_its_own(spark):
    rows = mapped(spark, [
        {"marketplace_sku": "1", "im_sku": " X ", "level_1": "l", "linworks_title": " "},
        {"marketplace_sku": "2", "im_sku": "X", "level_1": "first", "linworks_title": "one"},
        {"marketplace_sku": "3", "im_sku": "X", "level_1": "second", "linworks_title": "two"},
        {"marketplace_sku": "4", "im_sku": "X", "level_1": None, "linworks_title": "own"},
        {"marketplace_sku": "5", "im_sku": None, "level_1": None},
        {"marketplace_sku": "6", "im_sku": "Y", "level_1": " "},
    ])
    expected = [
        ("1", "X", "l", "one"), ("2", "X", "first", "one"), ("3", "X", "second", "two"),
        ("4", "X", "first", "own"), ("5", None, None, None), ("6", "Y", " ", None),
    ]
    columns = ["marketplace_sku", "im_sku", "level_1", "linworks_title"]
    assert pick(M.enrich_from_im_sku(rows), *columns) == expected
    assert pick(M.enrich_and_fill(rows), *columns) == expected


def _random_rows(rng, n, keys):
    return [
        {
            "marketplace_sku": f"s{rng.randrange(n)}", "asin": f"a{i}",
            "region": rng.choice(["DE", "IT"]), "im_sku": rng.choice(keys),
            "parent_sku": rng.choice([None, None, None, "", " p1 ", "p2", "p3"]),
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_fill_parent_equals_pandas_across_slices(spark, many_slices, seed):
    rng = random.Random(seed)
    hot = ["H"] * 6 if seed % 2 else []
    rows = _random_rows(rng, 300, [None, "", "A", "B", "C", *hot])
    df = mapped(spark, rows)
    pdf = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    pdf = pdf.sort_values(FEED_ORDER).astype(object)
    pdf["parent_sku"] = pdf["parent_sku"].map(lambda v: v.strip() if isinstance(v, str) else None)
    filled = pdf.groupby("im_sku")["parent_sku"].transform(lambda x: x.ffill().bfill())
    pdf["parent_sku"] = filled.where(pdf["im_sku"].notna(), pdf["parent_sku"])
    expected = sorted(
        (a, p if isinstance(p, str) else None) for a, p in zip(pdf["asin"], pdf["parent_sku"])
    )
    assert sorted(pick(M.fill_parent_by_im_sku(df), "asin", "parent_sku")) == expected
    sliced = M.stage_by_range(df, ["im_sku", *FEED_ORDER], "probe")
    assert sliced.select("_slice").distinct().count() > 1


def test_override_precedence_and_nulls(spark):
    cat = M.column_subset(M.mapped_only(catalogue(spark, [
        {"id": 1, "marketplace_sku": "S", "im_sku": " E ", "level_1": "exact"},
        {"id": 2, "marketplace_sku": "M-S", "im_sku": "ALT", "sales_channel": "ch"},
        {"id": 3, "marketplace_sku": "M-T", "im_sku": "T"},
    ])))
    rows = mapped(spark, [
        {"marketplace_sku": s, "im_sku": "own", "level_1": "own", "date": "d", "amazon_title": "a"}
        for s in ("S", "M-S", "T", "M-M-S", "U")
    ])
    records = M.last_by_sku_region(cat)
    columns = ["marketplace_sku", "im_sku", "level_1", "sales_channel", "date", "amazon_title"]
    step = M.override_by_sku_region(rows, records)
    assert pick(step, *columns) == [
        ("M-M-S", "own", "own", None, "d", "a"), ("M-S", "ALT", None, "ch", "d", "a"),
        ("S", "E", "exact", None, "d", "a"), ("T", "own", "own", None, "d", "a"),
        ("U", "own", "own", None, "d", "a"),
    ]
    expected = [
        ("M-M-S", "ALT", None, "ch", "d", "a"), ("M-S", "E", "exact", None, "d", "a"),
        ("S", "ALT", None, "ch", "d", "a"), ("T", "T", None, None, "d", "a"),
        ("U", "own", "own", None, "d", "a"),
    ]
    assert pick(M.override_by_alternate_sku(step, records), *columns) == expected
    assert pick(M.override_exact_and_alternate(rows, cat), *columns) == expected


def test_one_shuffle_override_equals_two_steps(spark):
    rng = random.Random(3)
    skus = ["A", "M-A", "M-M-A", "B", "M-B", "M-", "", "M-M-B"]
    cat = M.column_subset(M.mapped_only(catalogue(spark, [
        {"id": i, "marketplace_sku": rng.choice(skus), "region": rng.choice(["DE", "IT"]),
         "im_sku": f"i{i}", "parent_sku": rng.choice([None, f" p{i} "])}
        for i in range(9)
    ])))
    rows = mapped(spark, [{"marketplace_sku": s, "region": r} for s in skus for r in ("DE", "IT", "UK")])
    records = M.last_by_sku_region(cat)
    two = M.override_by_alternate_sku(M.override_by_sku_region(rows, records), records)
    assert pick(M.override_exact_and_alternate(rows, cat), *RECORD) == pick(two, *RECORD)

from __future__ import annotations

import random

import pytest

from skuflow.operators import joins as J
from skuflow.operators import publish as P
from skuflow.schemas import HIERARCHY
from tests.helpers import hierarchy, pick, staging

VALUES = [c for c in HIERARCHY.names if c not in ("marketplace_sku", "region")]


def _row_by_row(staged: list[dict], held: list[dict]) -> tuple[list[dict], list[int]]:
    """The publish, one key after the other."""
    groups: dict[tuple, dict] = {}
    ids: dict[tuple, list[int]] = {}
    for row in sorted(staged, key=lambda r: r["id"]):
        key = (row["marketplace_sku"], row["region"])
        group = groups.setdefault(key, dict.fromkeys(row))
        group.update({k: v for k, v in row.items() if v is not None})
        ids.setdefault(key, []).append(row["id"])
    blank = lambda v: v is None or v.strip() == ""
    held, left = [dict(h) for h in held], {r["id"] for r in staged}
    for key in sorted(groups):
        row = groups[key]
        if any(blank(row[c]) for c in ("marketplace_sku", "region", "asin")):
            continue
        same = lambda h: (h["marketplace_sku"], h["region"]) == key
        left -= set(ids[key])
        if blank(row["im_sku"]):
            held = [h for h in held if not same(h)]
            continue
        if not blank(row["parent_sku"]):
            for h in held:
                if h["im_sku"] == row["im_sku"]:
                    h["parent_sku"] = row["parent_sku"]
        new = {c: row.get(c) for c in HIERARCHY.names}
        if any(same(h) for h in held):
            held = [dict(new) if same(h) else h for h in held]
        else:
            held.append(new)
    return held, sorted(left)


def _random_case(rng):
    sku = lambda: rng.choice(["S1", "S2", "S3", "S4", "S5", " "])
    staged = [
        {
            "id": i, "marketplace_sku": sku(), "region": rng.choice(["DE", "IT"]),
            "asin": rng.choice(["A", "A", "B", ""]),
            "im_sku": rng.choice([None, "", "I1", "I2", "I3"]),
            "parent_sku": rng.choice([None, "", " ", "P1", "P2", "P3"]),
            "level_1": rng.choice([None, "", "L"]), "level_2": None, "level_3": None,
            "level_4": None, "level_5": None, "linworks_title": rng.choice([None, "T"]),
            "marketplace": "m", "marketplace_sales_table": "t", "channel": "c", "company": "x",
        }
        for i in range(rng.randrange(1, 12))
    ]
    held = [
        {**dict.fromkeys(HIERARCHY.names), "marketplace_sku": sku(), "region": rng.choice(["DE", "IT"]),
         "im_sku": rng.choice([None, "I1", "I2", "I3"]), "parent_sku": rng.choice([None, "H1", "H2"])}
        for _ in range(rng.randrange(0, 8))
    ]
    return staged, held


@pytest.mark.parametrize("seed", range(6))
def test_publish_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    # Many independent cases in one run: a case number joins every key.
    all_staged, all_held, want_held, want_left = [], [], [], []
    for case in range(60):
        staged, held = _random_case(rng)
        mark = lambda v: v if v is None or v.strip() == "" else f"{case}:{v}"  # noqa: E731, B023
        for row in staged + held:
            for c in ("marketplace_sku", "im_sku", "parent_sku"):
                row[c] = mark(row[c])
        staged = [{**r, "id": r["id"] + 1000 * case} for r in staged if r["marketplace_sku"].strip()]
        held = [h for h in held if h["marketplace_sku"].strip()]
        after, left = _row_by_row(staged, held)
        all_staged += staged
        all_held += held
        want_held += after
        want_left += left
    result = P.publish(staging(spark, all_staged), hierarchy(spark, all_held))
    key = lambda r: [(v is not None, v) for v in r]
    expected = sorted((tuple(h[c] for c in HIERARCHY.names) for h in want_held), key=key)
    assert pick(result.hierarchy, *HIERARCHY.names) == expected
    assert sorted(r.id for r in result.staging.collect()) == sorted(want_left)


def test_last_non_null_mixes_rows(spark):
    df = staging(spark, [
        {"id": 1, "marketplace_sku": "S", "level_1": "a", "parent_sku": "p"},
        {"id": 2, "marketplace_sku": "S", "level_1": None, "level_2": "b", "parent_sku": ""},
    ])
    assert pick(P.staging_last(df), "level_1", "level_2", "level_3", "parent_sku", "n_rows") == [
        ("a", "b", None, "", 2)
    ]


def test_actions_and_summary(spark):
    df = staging(spark, [
        {"id": 1, "marketplace_sku": " ", "im_sku": "I"},
        {"id": 2, "marketplace_sku": "U", "im_sku": " "},
        {"id": 3, "marketplace_sku": "N", "im_sku": "I"},
        {"id": 4, "marketplace_sku": "E", "im_sku": "I"},
        {"id": 5, "marketplace_sku": "L", "im_sku": "I" * 300, "parent_sku": "q"},
    ])
    held = hierarchy(spark, [
        {"marketplace_sku": "E", "region": "DE", "im_sku": "old"},
        {"marketplace_sku": "U", "region": "DE", "im_sku": "old"},
    ])
    result = P.publish(df, held, {"im_sku": 255})
    assert pick(result.actions, "marketplace_sku", "action", "exists", "n_rows") == [
        (" ", "skip", False, 1), ("E", "upsert", True, 1), ("L", "fail", False, 1),
        ("N", "upsert", False, 1), ("U", "unmap", True, 1),
    ]
    assert pick(result.summary, *result.summary.columns) == [(3, 1, 1)]
    assert sorted(r.id for r in result.staging.collect()) == [1, 5]
    assert pick(result.hierarchy, "marketplace_sku", "im_sku") == [("E", "I"), ("N", "I")]


def test_any_length_is_published_without_widths(spark):
    df = staging(spark, [{"id": 1, "marketplace_sku": "L", "im_sku": "I" * 300, "level_1": "x" * 256}])
    result = P.publish(df, hierarchy(spark, []))
    assert pick(result.actions, "action") == [("upsert",)]
    assert pick(result.hierarchy, "im_sku", "level_1") == [("I" * 300, "x" * 256)]
    assert result.staging.count() == 0


@pytest.fixture
def unmeasured(monkeypatch):
    """As with batches too large to broadcast."""
    for module in (P, J):
        monkeypatch.setattr(module, "fits", lambda df, limit=0: False)


def test_publish_of_a_large_batch_is_the_same(spark, unmeasured):
    test_publish_equals_row_by_row(spark, 11)
    test_actions_and_summary(spark)


def test_small_batch_moves_no_hierarchy_row(spark, conf, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    held = [{"marketplace_sku": f"S{i}", "region": "DE", "im_sku": "I1" if i % 3 else f"I{i}"} for i in range(500)]
    hierarchy(spark, held).write.parquet(str(tmp_path / "held"))
    large = spark.read.parquet(str(tmp_path / "held"))
    batch = staging(spark, [
        {"id": 1, "marketplace_sku": "S7", "im_sku": "I1", "parent_sku": "P"},
        {"id": 2, "marketplace_sku": "S8", "im_sku": None}, {"id": 3, "marketplace_sku": "N", "im_sku": "I9"},
    ])
    result = P.publish(batch, large)
    plan = result.hierarchy._jdf.queryExecution().executedPlan().toString()
    # Hierarchy rows meet broadcasts only; the one shuffle join is of the upserts and the keys
    # of the hierarchy that they meet.
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert len(joins) == 1 and "LeftAnti" in joins[0]
    assert result.hierarchy.count() == 500
    assert result.hierarchy.where("parent_sku = 'P'").count() == sum(r["im_sku"] == "I1" for r in held) - 1
    assert pick(result.actions, "marketplace_sku", "exists") == [("N", False), ("S7", True), ("S8", True)]


def test_absent_columns_take_defaults_and_nulls_stay(spark):
    batch = staging(spark, [{"id": 1, "marketplace_sku": "S", "im_sku": "I", "company": None}])
    held = hierarchy(spark, [])
    assert pick(P.publish(batch, held).hierarchy, "company", "channel") == [(None, "c")]
    less = batch.drop("company", "channel", "marketplace_sales_table", "level_1")
    assert pick(P.publish(less, held).hierarchy, "company", "channel", "marketplace_sales_table", "level_1") == [
        ("RDX", "Amazon", "stg_tr_amazon_raw", None)
    ]


def test_size_of_values(spark):
    rows = spark.createDataFrame([("ab", ("c", None)), (None, None)], "k string, s struct<a:string,b:bigint>")
    # Two letters and a third in a struct, and eight bytes for each of four values of two rows.
    assert J.fits(rows, 67) and not J.fits(rows, 66)
    assert J.fits(rows.limit(0), 0)

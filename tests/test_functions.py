from __future__ import annotations

import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skuflow import functions as fn


def _apply(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    rows = df.select("i", expr(F.col("c")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_strip_removes_what_python_strips(spark):
    spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    values = [f"{s}a{s}b{s}" for s in spaces] + ["", " \t ", None, "a​"]
    expected = [v if v is None else v.strip() for v in values]
    assert _apply(spark, fn.strip, values) == expected
    assert _apply(spark, fn.is_blank, values) == [not e for e in expected]


def test_keys(spark):
    values = ["  m-Sku1 ", "\tx ", None, ""]
    assert _apply(spark, fn.norm_key_sql, values) == ["M-SKU1", "\tX ", None, ""]
    assert _apply(spark, fn.norm_key_py, values) == ["M-SKU1", "X", None, ""]
    assert _apply(spark, fn.edit_strip, [" a ", "  ", "", None]) == ["a", "", None, None]


def test_base_and_plus(spark):
    assert _apply(spark, fn.base_sku, ["A+", "A++", "A", "+", "", None]) == [
        "A", "A+", "A", "", "", None,
    ]
    assert _apply(spark, fn.plus_sku, ["A", None]) == ["A+", None]


def test_toggle_prefix(spark):
    values = ["M-A", "A", "M-M-A", "m-A", "M-", "", None]
    expected = ["A", "M-A", "M-A", "M-m-A", "", "M-", None]
    assert _apply(spark, fn.toggle_prefix, values) == expected


def test_fixed_maps(spark):
    assert _apply(spark, fn.company_for_region, ["IT", "UK", "DE", "ES", "FR", None]) == [
        "B2fitness", "B2fitness", "B2fitness", "B2fitness LTD", None, None,
    ]
    assert _apply(spark, fn.canonical_channel, ["Amazon.co.uk", "Amazon.de", None]) == [
        "Amazon.uk", "Amazon.de", None,
    ]
    assert _apply(spark, fn.null_if_marker, ["None", "nan", "NaT", "", "x", None]) == [
        None, None, None, "", "x", None,
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_datetime_text_is_pythons(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    values = [
        datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 500000),
        datetime(2024, 3, 10, 2, 30), datetime(2024, 1, 2, 3, 4, 5, 7), None,
    ]
    expected = [None if v is None else str(v) for v in values]
    assert _apply(spark, fn.datetime_text, values, "timestamp_ntz") == expected
    iso = [None if v is None else v.isoformat() + "Z" for v in values]
    assert _apply(spark, fn.iso_text, values, "timestamp_ntz") == iso


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_now_is_utc(spark, conf, zone):
    conf(spark__sql__session__timeZone=zone)
    got = spark.range(1).select(fn.utc_now()).first()[0]
    assert abs((datetime.now(timezone.utc).replace(tzinfo=None) - got).total_seconds()) < 60


def test_department(spark):
    rows = [("a", "b", "c"), (" ", "b", "c"), (None, "", "c"), (None, None, "\t")]
    df = spark.createDataFrame(rows, "modified_by string, modified_by_finance string, modified_by_admin string")
    got = [r[0] for r in df.select(fn.department_of()).collect()]
    assert got == ["SCM", "FINANCE", "ADMIN", None]


def test_iexact(spark):
    df = spark.createDataFrame([("Ab", "aB"), ("a", "a "), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(fn.iexact(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, None]

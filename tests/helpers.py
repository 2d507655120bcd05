"""Small frames from dicts, and rows back as comparable tuples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skuflow import schemas as S

NOW = datetime(2024, 6, 1)
OLD = datetime(2024, 1, 1)
MAPPED = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*S.RECORD, "feed_channel"]]
)


def frame(spark: SparkSession, schema: T.StructType, rows: list[dict]) -> DataFrame:
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    names = loose.fieldNames()
    assert not {k for r in rows for k in r} - set(names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], loose)


def mapped(spark, rows):
    base = {"marketplace_sku": "S", "asin": "A", "region": "DE", "feed_channel": "C"}
    return frame(spark, MAPPED, [{**base, **r} for r in rows])


def catalogue(spark, rows):
    base = {"marketplace_sku": "S", "asin": "A", "region": "DE", "created_at": OLD, "updated_at": OLD}
    return frame(spark, S.CATALOGUE, [{**base, **r} for r in rows])


def staging(spark, rows):
    base = {
        "asin": "A", "region": "DE", "marketplace": "m", "marketplace_sales_table": "t",
        "channel": "c", "company": "x", "created_at": OLD, "updated_at": OLD,
    }
    return frame(spark, S.STAGING, [{**base, **r} for r in rows])


def hierarchy(spark, rows):
    return frame(spark, S.HIERARCHY, rows)


def edits(spark, rows):
    base = {
        "edit_seq": 1, "id": 1, "marketplace_sku": "S", "asin": "A", "region": "DE",
        "sales_channel": "Amazon.de",
    }
    return frame(spark, S.EDITS, [{**base, **r} for r in rows])


def pick(df: DataFrame, *columns: str) -> list[tuple]:
    """Sorted tuples of the columns; None sorts first."""
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: [(v is not None, str(v)) for v in r])

"""One key holds a third of the rows and more: no task may get all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skuflow.operators import feeds as D
from skuflow.operators import mapping as M
from skuflow.operators import publish as P
from skuflow.session import stage
from tests.helpers import MAPPED

N = 60_000


@pytest.fixture
def skewed(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    key = F.when(F.col("id") % 2 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    values = {
        "marketplace_sku": F.concat(F.lit("s"), "id"), "asin": key, "region": F.lit("DE"),
        "im_sku": key, "parent_sku": F.when(F.col("id") % 100 == 0, F.concat(F.lit("p"), "id")),
        "level_1": F.when(F.col("id") % 7 == 0, "l"), "linworks_title": F.lit("t"),
        "comment": F.sha2(F.col("id").cast("string"), 512), "feed_channel": F.lit("c"),
    }
    rows = spark.range(N).repartition(8).select(*[
        values.get(f.name, F.lit(None)).cast("string").alias(f.name) for f in MAPPED
    ])
    return stage(rows, "skewed")


def _final_plan(df):
    assert df.count() is not None
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [
    M.harmonise_im_sku,
    M.enrich_from_im_sku,
    M.enrich_and_fill,
    lambda df: M.override_by_sku_region(
        df.withColumn("marketplace_sku", F.col("asin")),
        M.last_by_sku_region(
            df.withColumns({"id": F.lit(1), "marketplace_sku": F.col("asin")})
        ),
    ),
    lambda df: P.propagate_parent_on_publish(df, df.withColumn("action", F.lit("upsert"))),
    lambda df: D.attach_latest_title(
        df.select(F.col("asin").alias("seller_sku"), F.col("marketplace_sku").alias("asin"), "region", F.col("feed_channel").alias("sales_channel"), "comment"),
        D.latest_title(df.select(
            F.col("asin").alias("seller_sku"), F.col("feed_channel").alias("sales_channel"),
            F.lit(None).cast("timestamp_ntz").alias("purchase_date"), F.col("comment").alias("title"),
        )),
    ),
])
def test_hot_partitions_are_split(skewed, operator, monkeypatch):
    # A side that was measured as small would be broadcast; this is about the others.
    monkeypatch.setattr(P, "fits", lambda df: False)
    assert "skew=true" in _final_plan(operator(skewed))


def test_hot_key_is_spread_over_slices(skewed):
    sliced = M.stage_by_range(skewed, ["im_sku", *M.FEED_ORDER], "probe")
    share = sliced.groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert share < N / 3


def test_results_with_a_hot_key(skewed):
    filled = M.fill_parent_by_im_sku(skewed).where("im_sku = 'HOT'")
    order = skewed.where("im_sku = 'HOT'").select("marketplace_sku", "parent_sku").toPandas()
    order = order.sort_values("marketplace_sku")
    expected = dict(zip(order.marketplace_sku, order.parent_sku.ffill().bfill()))
    assert dict(filled.select("marketplace_sku", "parent_sku").toPandas().values) == expected

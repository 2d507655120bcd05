"""The given benchmark tables as this library's inputs (expressions: FIXTURES.md).

Whole tables, one input row each. Keys derive from the tables' own keys by division, so
key counts grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.schemas import CATALOGUE, EDITS, FEED, HIERARCHY, STAGING
from skuflow.sources.tables import conform

REGIONS = ["DE", "ES", "IT", "UK"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region(expr: str) -> str:
    return f"case {expr} when 0 then 'DE' when 1 then 'ES' when 2 then 'IT' else 'UK' end"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines; the region column stands for the four regional tables."""
    suffix = "case l_suppkey % 5 when 0 then 'de' when 1 then 'es' when 2 then 'it' else 'co.uk' end"
    return conform(
        _table(spark, sf_dir, "lineitem").selectExpr(
            "concat('  ', case when l_suppkey % 4 = 0 then 'm-' else '' end, 'sku', l_partkey div 5, ' ') as seller_sku",
            "concat('B', lpad(cast(l_partkey div 13 as string), 9, '0')) as asin",
            f"{_region('l_suppkey % 5')} as region",
            f"""case l_returnflag when 'N' then 'Non-Amazon'
                 when 'A' then concat(' Amazon.', {suffix})
                 else case when l_linenumber % 2 = 0 then 'amazon.de' end end as sales_channel""",
            "l_shipdate as purchase_date",
            "concat('Item ', l_partkey, ' of ', l_suppkey) as title",
            "case when l_linestatus = 'F' then 'Shipped' else 'Pending' end as order_status",
        ),
        FEED,
    )


def regional_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The feed as four inputs, one per region."""
    return {r: feed(spark, sf_dir).where(F.col("region") == r) for r in REGIONS}


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = "timestamp_ntz'2024-01-01' + make_dt_interval(cast(p_partkey % 400 as int))"
    plus = "case when p_partkey % 7 = 0 then '+' else '' end"
    return conform(
        _table(spark, sf_dir, "part").selectExpr(
            "p_partkey as id",
            "case when p_partkey % 2 = 0 then '2023-01-01 00:00:00' end as date",
            "concat(case when p_partkey % 3 = 0 then 'M-' else '' end, 'SKU', p_partkey div 5) as marketplace_sku",
            "concat('B', lpad(cast(p_partkey div 13 as string), 9, '0')) as asin",
            # Two branches that are no constants: with one, Spark moves what is asked of the column
            # into the branches and works out lower('') in the driver, which then fills its
            # tables of letter cases (3 GB of garbage, some 200 MB more heap).
            f"""case when p_partkey % 5 = 0 then null when p_partkey % 31 = 0 then ''
                 when (p_partkey div 13) % 3 < 2 then concat('IM', p_partkey div 26, {plus})
                 else concat('IM', 1000000 + p_partkey div 6, {plus}) end as im_sku""",
            f"{_region('p_size % 4')} as region",
            "case p_size % 3 when 0 then 'AMAZON.DE' when 1 then 'Amazon.co.uk' else 'Amazon.it' end as sales_channel",
            "case when p_partkey % 3 = 0 then null when p_partkey % 13 = 0 then '  ' else p_type end as level_1",
            "case when p_partkey % 4 <> 1 then concat(' ', p_name) end as linworks_title",
            "case when p_partkey % 3 = 0 then concat('old ', p_name) end as amazon_title",
            "case when p_partkey % 6 >= 3 then concat(' P', p_partkey % 25, ' ') end as parent_sku",
            "case when p_partkey % 2 = 1 then concat('scm', p_partkey % 3) end as modified_by",
            "case when p_partkey % 7 = 1 then 'fin' end as modified_by_finance",
            "case when p_partkey % 4 = 0 then concat('note ', p_partkey) end as comment",
            f"{created} as created_at",
            f"{created} as updated_at",
        ),
        CATALOGUE,
    )


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders. Keys repeat on purpose: the publish step takes the last value of each."""
    return conform(
        _table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey as id",
            "case when o_orderkey % 97 = 0 then ' ' else concat('SKU', o_orderkey div 10) end as marketplace_sku",
            "case when o_orderkey % 89 = 0 then '' else concat('B', lpad(cast(o_orderkey div 20 as string), 9, '0')) end as asin",
            "case when o_custkey % 3 > 0 then concat('IM', o_orderkey div 40) end as im_sku",
            """case when o_orderkey % 8 = 2 then null when o_orderkey % 16 = 5 then ' '
                 else concat('P', o_orderkey % 25) end as parent_sku""",
            f"{_region('o_custkey % 4')} as region",
            "'Amazon.uk' as marketplace",
            "case when o_custkey % 2 = 0 then o_orderpriority end as level_1",
            "case when o_custkey % 5 = 0 then o_orderstatus end as level_2",
            "case when o_orderkey % 7 <> 0 then concat('T', o_orderkey) end as linworks_title",
            "'stg_tr_amazon_raw' as marketplace_sales_table",
            "'Amazon' as channel",
            "'B2fitness' as company",
            "case when o_orderkey % 4 = 0 then concat('scm', o_orderkey % 3) end as modified_by",
            "o_orderdate as created_at",
            "o_orderdate as updated_at",
        ),
        STAGING,
    )


def staged_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers as an earlier staging table with unique SKUs, for the edits."""
    return conform(
        _table(spark, sf_dir, "supplier").selectExpr(
            "s_suppkey * 3 as id",
            "concat('SKU', s_suppkey * 3 + case when s_suppkey % 5 = 0 then 1 else 0 end) as marketplace_sku",
            "concat('B', lpad(cast(s_suppkey div 4 as string), 9, '0')) as asin",
            f"{_region('s_nationkey % 4')} as region",
            "'Amazon.it' as marketplace",
            "'L2' as level_2",
            "'stg_tr_amazon_raw' as marketplace_sales_table",
            "'Amazon' as channel",
            "'B2fitness' as company",
            "s_name as comment",
            "timestamp_ntz'2024-01-01' as created_at",
            "timestamp_ntz'2024-01-01' as updated_at",
        ),
        STAGING,
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(
        _table(spark, sf_dir, "part").selectExpr(
            "concat('SKU', p_partkey) as marketplace_sku",
            "concat('B', lpad(cast(p_partkey div 13 as string), 9, '0')) as asin",
            "concat('IM', p_partkey div 5) as im_sku",
            "concat('H', p_partkey % 5) as parent_sku",
            f"{_region('p_size % 4')} as region",
            "'Amazon.uk' as marketplace",
            "p_type as level_1",
            "p_brand as level_2",
            "'B2fitness' as company",
            "'stg_tr_amazon_raw' as marketplace_sales_table",
            "'Amazon' as channel",
            "p_name as linworks_title",
        ),
        HIERARCHY,
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; four consecutive events edit one id."""
    region = "case when user_id % 10 = 9 then 'FR' else " + _region("user_id % 4") + " end"
    return conform(
        _table(spark, sf_dir, "events").selectExpr(
            "event_id as edit_seq",
            "event_id div 4 as id",
            "concat('SKU', event_id div 4 + case when event_id % 40 = 7 then 1 else 0 end) as marketplace_sku",
            """case when event_id % 101 = 0 then null
                 else concat('B', lpad(cast(event_id div 52 + case when event_id % 3 = 0 then 1 else 0 end as string), 9, '0'))
               end as asin""",
            f"{region} as region",
            "case when event_id % 400 = 0 then '' else concat(' im', event_id div 104, ' ') end as im_sku",
            """case event_id % 6 when 0 then null when 1 then '  ' when 2 then ''
                 else concat(' E', event_id % 7) end as parent_sku""",
            "case user_id % 4 when 0 then 'Amazon.de' when 1 then 'Amazon.es' when 2 then 'Amazon.it' else 'Amazon.co.uk' end as sales_channel",
            "case when event_id % 2 = 1 then concat('L', user_id % 10) end as level_1",
            "case when event_id % 5 >= 3 then concat('edited ', event_id) end as linworks_title",
            "case when event_id % 9 = 0 then props end as comment",
            "case when event_type = 'click' then concat('scm', user_id) else ' ' end as modified_by",
            "case when event_type = 'purchase' then concat('fin', user_id) end as modified_by_finance",
            "case when event_type in ('error', 'click') then concat('adm', user_id) end as modified_by_admin",
        ),
        EDITS,
    )

"""Readers and writers: feeds, catalogue CSV, JSON, and versioned table snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.functions import CSV_NULLS, is_blank, iso_text
from skuflow.schemas import CSV_COLUMN_NAMES, CSV_OPTIONAL, FEED, FEED_COLUMN_NAMES

POSITION = "_position"


def conform(
    df: DataFrame, schema: T.StructType, names: Mapping[str, str] | None = None,
    defaults: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Rename, add missing columns with their default, cast and order.

    A default stands in for a missing column only, never for a null value.
    """
    df = df.withColumnsRenamed(dict(names or {}))
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name)))
        .cast(f.dataType).alias(f.name)
        for f in schema
    ])


def require_fields(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all ``columns`` non-blank, and the skipped rest."""
    blank: Column = F.lit(False)
    for c in columns:
        blank = blank | is_blank(F.col(c))
    return df.where(~blank), df.where(blank)


def read_feeds(
    spark: SparkSession, sources: Mapping[str, str | DataFrame | Mapping[str, str]]
) -> dict[str, DataFrame]:
    """One conformed feed per region.

    A source is a parquet path, a DataFrame, or JDBC options; for JDBC give
    ``partitionColumn``, bounds and ``numPartitions`` so that the read is parallel.
    """
    feeds = {}
    for region, source in sources.items():
        if isinstance(source, DataFrame):
            df = source
        elif isinstance(source, str):
            df = spark.read.parquet(source)
        else:
            df = spark.read.format("jdbc").options(**source).load()
        feeds[region] = conform(df, FEED, FEED_COLUMN_NAMES)
    return feeds


def read_catalogue_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, positions: bool = False,
) -> DataFrame:
    """Catalogue rows of CSV files with a header; ``Comment`` is optional.

    Columns are found by name. Quoted fields may hold line breaks, so a file is one
    task; for files without them ``multi_line=False`` lets Spark split each file.

    ``positions`` adds ``POSITION``, by which rows sort as they stand: files by path, then
    the block of the file that a task reads, then the row among those the task reads. The last
    is comparable inside a block only, which is all that the sort asks of it.
    """
    raw = (
        spark.read.option("header", True).option("escape", '"')
        .option("multiLine", multi_line).option("enforceSchema", False).csv(path)
    )
    columns = []
    for source, name in CSV_COLUMN_NAMES.items():
        if source in raw.columns:
            value = F.col(f"`{source}`")
            value = F.when(~value.isin(CSV_NULLS), value)
        elif source in CSV_OPTIONAL:
            value = F.lit(None).cast("string")
        else:
            raise ValueError(f"column {source!r} is missing in {path}")
        columns.append(value.alias(name))
    if positions:
        block = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
        columns.append(F.struct(*block, F.monotonically_increasing_id().alias("row")).alias(POSITION))
    return raw.select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; quotes are doubled and blanks kept (K3)."""
    (
        df.write.option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_bucketed(
    df: DataFrame, name: str, path: str, keys: list[str], buckets: int
) -> DataFrame:
    """Write a table bucketed and sorted by ``keys`` and return it.

    Joins and groupings by all the keys then need no shuffle of it. A bucket is one task, so
    the keys must be (nearly) unique: a hot one would fill its bucket.
    """
    (
        df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def write_feed(feed: DataFrame, path: str) -> None:
    """The feed of all regions as one table, a folder for each region."""
    feed.write.partitionBy("region").parquet(path)


def read_feed(spark: SparkSession, path: str, regions: DataFrame | None = None) -> DataFrame:
    """A feed written by ``write_feed``, of all regions or of those in ``regions``.

    The regions may come out of any query. They are broadcast, one row for each folder at most
    as others match none, and the scan opens their folders only.
    """
    feed = spark.read.schema(FEED).parquet(path)
    if regions is None:
        return feed
    folders = feed.select("region").distinct()
    wanted = regions.select("region").distinct().join(folders, "region", "left_semi")
    return feed.join(F.broadcast(wanted), "region", "left_semi").select(*FEED.names)


def dashboard_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON records, null fields included (K5)."""
    fields = [
        iso_text(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        else F.col(f.name)
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def lookup_by_id(df: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """Rows of the given ids; many ids come as a DataFrame.

    Repeated ids are dropped before the join: the right side of a semi join is not split.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select("id").distinct(), "id", "left_semi")
    return df.where(F.col("id").isin(ids))


# Snapshots: <root>/v=<number>/<table>, valid once <root>/v=<number>/_COMMITTED exists.
_MARKER = "_COMMITTED"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _matches(spark: SparkSession, pattern: str) -> set[int]:
    """Numbers of the snapshots that hold a file."""
    fs, target = _fs(spark, pattern)
    found = fs.globStatus(target) or []
    return {int(status.getPath().getParent().getName()[2:]) for status in found}


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed snapshot numbers, ascending."""
    return sorted(_matches(spark, f"{root}/v=*/{_MARKER}"))


def _touch(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.create(target, True).close()


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of the newest committed snapshot, or of a given one (S3).

    A snapshot holds the tables it changed; the others are found in earlier ones.
    """
    held = _matches(spark, f"{root}/v=*/{name}") & set(versions(spark, root))
    known = [v for v in held if version is None or v <= version]
    if not known:
        raise LookupError(f"no snapshot of {name!r} below {root}")
    return spark.read.parquet(f"{root}/v={max(known)}/{name}")


def committed(spark: SparkSession, root: str, txn: str) -> bool:
    """Whether a snapshot was committed under this transaction name."""
    return bool(_matches(spark, f"{root}/v=*/_TXN_{txn}") & set(versions(spark, root)))


def commit(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], txn: str | None = None
) -> int:
    """Write the changed tables as one snapshot; readers see all of it or none (K4).

    An interrupted attempt leaves no marker and its number is written again. There is one
    writer per root.
    """
    done = versions(spark, root)
    version = done[-1] + 1 if done else 1
    folder = f"{root}/v={version}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    if txn:
        _touch(spark, f"{folder}/_TXN_{txn}")
    _touch(spark, f"{folder}/{_MARKER}")
    return version

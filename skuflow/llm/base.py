"""What the operators share: text columns, Arrow buffers, running sums over all rows."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.operators.ordered import SLICE, stage_by_range

# The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the library to the Python workers, as ``--py-files`` would, once a session.

    The archive is made on the driver and fetched from there by the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as folder:
        archive = Path(folder) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        # Kept below Spark's own folder for files it serves, which ends with the session.
        served = Path(SparkFiles.getRootDirectory()) / f"{root.name}-{context.applicationId}.zip"
        served.write_bytes(archive.read_bytes())
    context.addPyFile(str(served))
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_text(docs: DataFrame) -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, whatever other columns there are."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))


def fold(divisor: int) -> Column:
    """Remainder of the CRC-32 of ``doc_id`` as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def word_list(text: Column) -> Column:
    """The words of a text as an array, in order."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def running_start(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str], label: str
) -> DataFrame:
    """Add, for each ``new: value`` of ``sums``, the sum of ``value`` over the rows before
    this one in its group, and return the table.

    Groups may hold any share of the rows: rows are ranged by (group, order) and staged, a
    slice adds up its own rows, and what slices pass on is one row per slice and group.
    ``order`` should tell rows apart; rows equal in it are interchangeable.
    """
    keys = [*group, *order]
    sliced = stage_by_range(df, keys, label)
    local = Window.partitionBy(SLICE, *group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = sliced.groupBy(SLICE, *group).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()]
    )
    # Rows here: fewer than slices plus groups.
    across = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col(SLICE).alias("_s"), *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    on = sliced[SLICE] == before["_s"]
    for g in group:
        on = on & sliced[g].eqNullSafe(before[f"_g_{g}"])
    local_sums = {
        f"_l_{n}": F.sum(v).over(local) - F.col(v) for n, v in sums.items()
    }
    out = {n: (F.col(f"_b_{n}") + F.col(f"_l_{n}")).cast("long") for n in sums}
    return (
        sliced.withColumns(local_sums).join(before, on, "left")
        .select(*df.columns, *[c.alias(n) for n, c in out.items()])
    )


# Arrow and NumPy.

#: Bytes of text that a Python task works on at once.
CHUNK_BYTES = 2 << 20


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its values (one more than values)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offset_buffer, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offset_buffer, kind)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``CHUNK_BYTES`` of text, whole texts each."""
    _, offsets = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of ``length`` numbers for each pair, one after another."""
    lengths = lengths.astype(np.int64)
    out = np.repeat(starts.astype(np.int64) - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out

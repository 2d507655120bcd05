"""Operator 8: pack documents into sequences of bounded length by cutting stock.

Defined results: a null or empty text is the end token alone; rows that share a ``doc_id``
are documents of their own; an empty table gives no pieces; other columns are ignored, so
their names cannot clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.llm.base import buffers, chunks, documents, running_start, texts
from skuflow.llm.cutting_stock import patterns
from skuflow.llm.vocabularies import unit_encoder, vocabulary_path
from skuflow.session import stage

CAPACITY = 1024
#: Tokens of a length class.
GRAIN = 8
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise whole texts, append the end id and cut each document into pieces.

    Pieces of a document: full ones from its start, then what is left. ``with_ids`` adds
    the ids of each piece as little-endian unsigned 32-bit numbers.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches):
        with unit_encoder(vocabulary, lower=False, leading_space=True).task() as encoder:
            yield from cut_with(encoder, batches)

    def cut_with(encoder, batches):
        for batch in batches:
            for part in chunks(batch):
                ids, ends = encoder.encode(*buffers(part.column("text")))
                n = part.num_rows
                tokens = np.diff(ends) + 1  # with the end id
                flat = np.full(len(ids) + n, end_id, "<u4")
                place = np.ones(len(flat), bool)
                place[np.cumsum(tokens) - 1] = False
                flat[place] = ids
                per_doc = -(-tokens // capacity)
                doc = np.repeat(np.arange(n), per_doc)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                start = k * capacity
                length = np.minimum(capacity, tokens[doc] - start)
                at = (np.cumsum(tokens) - tokens)[doc] + start
                raw = memoryview(flat.tobytes())
                bounds = zip((at * 4).tolist(), ((at + length) * 4).tolist(), strict=True)
                cuts = [raw[a:b] for a, b in bounds]
                columns = [
                    part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length),
                    pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                    pa.array(tokens[doc]),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cuts], pa.binary()))
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts(docs).mapInArrow(cut, schema)


_LAYOUT = T.StructType([
    T.StructField("klass", T.LongType()), T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()), T.StructField("copies", T.LongType()),
    T.StructField("first_sequence", T.LongType()), T.StructField("place", T.LongType()),
])


def layout(histogram: dict[int, int], room: int) -> list[tuple[int, ...]]:
    """Which ranks of each length class go to which sequences: rows of ``_LAYOUT``.

    Classes and ``room`` are in grains. Full pieces are sequences of their own, first.
    """
    full = histogram.get(room, 0)
    rows = [(room, 0, full, 1, 0, 0)] if full else []
    sequence = full
    rank: dict[int, int] = {}
    for pattern, times in patterns({k: n for k, n in histogram.items() if k != room}, room):
        for place, (klass, copies) in enumerate(pattern):
            lo = rank.get(klass, 0)
            rank[klass] = lo + copies * times
            rows.append((klass, lo, rank[klass], copies, sequence, place))
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``start``, ``length``.

    The histogram counts lengths in classes of ``grain`` tokens, rounded up: the linear
    program has ``capacity / grain`` rows and costs under ``grain`` tokens of padding for
    each piece. Pieces of a class are ranked by (doc_id, start) and a class's ranks are
    dealt to the patterns that use it. Offsets add up true lengths, so there are no gaps; a
    sequence has at most ``capacity`` pieces. The layout has a row for each class of each
    pattern, and there are at most as many patterns as classes and bins left over from
    rounding, so it is safe to broadcast.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumns({
        "_class": F.ceil(F.col("length") / grain).cast("long"), "_one": F.lit(1)
    })
    counted = classed.groupBy("_class").count().collect()  # at most capacity / grain rows
    rows = layout({r["_class"]: r["count"] for r in counted}, capacity // grain)
    table = F.broadcast(spark.createDataFrame(rows, _LAYOUT))
    rest = [c for c in pieces.columns if c not in ("doc_id", "start", "ids")]
    ranked = running_start(
        classed, ["_class"], ["doc_id", "start", *rest], {"_rank": "_one"}, "ranked-pieces"
    )
    on = (
        (F.col("_class") == F.col("klass"))
        & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))
    )
    nth = F.col("_rank") - F.col("lo")
    placed = ranked.join(table, on).select(
        *pieces.columns, "place", nth.alias("_nth"),
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
    )
    before = Window.partitionBy("sequence_id").orderBy("place", "_nth").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places. Tokenising is done once and staged."""
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    return pack(stage(token_pieces(docs, vocabulary), "pieces"))


def op8_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))

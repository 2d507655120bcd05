"""Operator 10: token files of directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of eight bits;
level 0 has the lowest chunk of every id, level k the k-th chunk of those that go on. A
bitmap tells which ids of a level go on, and a rank directory counts its ones before each
block, so the chunk of any id in the next level is found at once: random access without
decoding what stands before.

Files are Parquet, written and read by Spark, one row for each segment; ascending
(part, seq) is ascending ``doc_id``.

Rows are dealt to tasks by ranges of (``doc_id``, number of ids, XXH64 of the ids, number
given to the row), so that rows which share a ``doc_id``, or are equal, spread as well.

Defined results: a null or empty text is the end token alone; a long text is one document
whatever its length, in a segment of its own if it fills one; documents that share a
``doc_id`` follow each other by (number of ids, their XXH64), and rows equal in these in any
order; null ids come first; an empty table gives files without segments; other columns are
ignored, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import buffers, chunks, documents, running_start, ship, texts
from skuflow.llm.vocabularies import unit_encoder, vocabulary_path
from skuflow.session import drop_at_exit, new_path

END_ID = 2
#: Ids after which a segment is closed at the end of a document.
SEGMENT_TOKENS = 1 << 18
BLOCK_BITS = 512

SEGMENT = (
    "part int, seq int, n_tokens long, doc_ids array<bigint>, doc_ends array<bigint>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)
_NAMES = [f.split()[0] for f in SEGMENT.split(", ")]


class Codes:
    """Directly addressable codes of one segment."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        chunks, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
            rest = rest >> 8
            goes_on = rest > 0
            if not goes_on.any():
                return cls(chunks, bitmaps, ranks)
            bitmaps.append(np.packbits(goes_on, bitorder="little").tobytes())
            ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK_BITS), dtype=np.int64)
            ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
            rest = rest[goes_on]

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the bitmap before each position."""
        block = at // BLOCK_BITS
        width = BLOCK_BITS // 8
        bits = self.bitmaps[level]
        counts = self.ranks[level][np.minimum(block, len(self.ranks[level]) - 1)].astype(np.int64)
        byte = at // 8
        for k in range(width):  # whole bytes of the block, at most 64 of them
            use = block * width + k < byte
            if not use.any():
                break
            where = np.minimum(block * width + k, len(bits) - 1)
            counts += np.where(use, np.bitwise_count(bits[where]), 0)
        last = bits[np.minimum(byte, len(bits) - 1)] & ((1 << (at % 8)) - 1).astype(np.uint8)
        return counts + np.where(byte < len(bits), np.bitwise_count(last), 0)

    def _rank_at(self, level: int, at: int) -> int:
        """Ones of the bitmap before one position."""
        block, byte = at // BLOCK_BITS, at // 8
        bits, ranks = self.bitmaps[level], self.ranks[level]
        if block >= len(ranks):  # behind the last block
            block -= 1
        first = block * (BLOCK_BITS // 8)
        count = int(ranks[block]) + int(np.bitwise_count(bits[first:byte]).sum(dtype=np.int64))
        return count + (int(bits[byte]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else count

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at = np.asarray(positions, np.int64)
        out = self.chunks[0][at].astype(np.uint32)
        index = np.arange(len(at))
        for level in range(len(self.bitmaps)):
            bits = self.bitmaps[level]
            on = (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            index, at = index[on], self._rank(level, at[on])
            out[index] |= self.chunks[level + 1][at].astype(np.uint32) << np.uint32(8 * (level + 1))
        return out

    def run(self, start: int, end: int) -> np.ndarray:
        """The ids of a run of positions: one run in each level, as levels keep the order."""
        out = self.chunks[0][start:end].astype(np.uint32)
        index = None
        for level in range(len(self.bitmaps)):
            byte = start // 8
            bits = np.unpackbits(self.bitmaps[level][byte:(end + 7) // 8], bitorder="little")
            on = np.flatnonzero(bits[start - 8 * byte:end - 8 * byte])
            if not len(on):
                break
            start = self._rank_at(level, start)
            end = start + len(on)
            index = on if index is None else index[on]
            chunk = self.chunks[level + 1][start:end].astype(np.uint32)
            out[index] |= chunk << np.uint32(8 * (level + 1))
        return out


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id`` and the ids of whole texts, two bytes each."""

    def encode(batches):
        with unit_encoder(vocabulary, lower=True, leading_space=False).task() as encoder:
            yield from encode_with(encoder, batches)

    def encode_with(encoder, batches):
        for batch in batches:
            for part in chunks(batch):
                ids, ends = encoder.encode(*buffers(part.column("text")))
                n = part.num_rows
                flat = np.full(len(ids) + n, end_id, "<u2")
                stops = ends + np.arange(n + 1)
                place = np.ones(len(flat), bool)
                place[stops[1:] - 1] = False
                flat[place] = ids
                rows = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n,
                    [None, pa.py_buffer(stops.astype(np.int64) * 2), pa.py_buffer(flat)],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), rows.cast(pa.binary())], names=["doc_id", "ids"],
                )

    return texts(docs).mapInArrow(encode, "doc_id long, ids binary")


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Close a segment when it is full. Rows of a task are one part and come in order."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # ids, lengths, keys of runs
    size, part, seq = 0, 0, 0
    types = [
        pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
        pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()),
    ]

    def close():
        ids = np.concatenate([x for x, _, _ in held])
        codes = Codes.of(ids)
        ends = np.cumsum(np.concatenate([n for _, n, _ in held]))
        row = [
            part, seq, len(ids), pa.concat_arrays([k for _, _, k in held]), ends,
            [c.tobytes() for c in codes.chunks], [b.tobytes() for b in codes.bitmaps],
            [r.tobytes() for r in codes.ranks],
        ]
        arrays = [pa.array([x], t) for x, t in zip(row, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    for batch in batches:
        for run in chunks(batch, "ids"):
            part = run.column("part")[0].as_py()
            raw, at = buffers(run.column("ids"))
            ids, at = np.ascontiguousarray(raw).view("<u2"), at // 2
            first = 0
            while first < run.num_rows:
                # The first document that fills the segment is its last.
                last = int(np.searchsorted(at, at[first] + SEGMENT_TOKENS - size))
                last = min(max(last, first + 1), run.num_rows)
                held.append((
                    ids[at[first]:at[last]].copy(), np.diff(at[first:last + 1]),
                    run.column("doc_id").slice(first, last - first),
                ))
                size += int(at[last] - at[first])
                first = last
                if size >= SEGMENT_TOKENS:
                    yield close()
                    held, size, seq = [], 0, seq + 1
    if held:
        yield close()


def _stored(ids: DataFrame) -> DataFrame:
    """A stage table of ids, which the default codec does not make smaller."""
    path = new_path(ids.sparkSession, "token-ids")
    ids.write.option("compression", "zstd").parquet(path)
    drop_at_exit(ids.sparkSession, path)
    return ids.sparkSession.read.schema(ids.schema).parquet(path)


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID
) -> None:
    """Write the ids of all documents in ascending ``doc_id`` order.

    Texts are tokenised once and staged as ids; the ranges come from a sample of the order's
    narrow columns.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    order = {
        "doc_id": F.col("doc_id"), "_size": F.length("ids"), "_hash": F.xxhash64("ids"),
        "_row": F.monotonically_increasing_id(),
    }
    encoded = encode_documents(docs, vocabulary, end_id)
    tokens = _stored(encoded.select("ids", *[c.alias(n) for n, c in order.items()]))
    (
        tokens.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "doc_id", "ids")
        .mapInArrow(_segments, SEGMENT)
        .write.option("compression", "zstd").parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files in any order: segment, position in it, CRC-32 of the ids as
    little-endian unsigned 32-bit numbers, and with ``with_ids`` those bytes."""
    ship(spark)
    schema = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""
    names = [f.split()[0] for f in schema.split(", ")]

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]  # one segment
                codes = Codes(row["chunks"], row["bitmaps"], row["ranks"])
                ends = np.array(row["doc_ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                raw = [
                    codes.run(a, b).astype("<u4").tobytes()
                    for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
                ]
                n = len(ends)
                columns = [
                    pa.array(np.full(n, row["part"], np.int32)),
                    pa.array(np.full(n, row["seq"], np.int32)),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts),
                    pa.array(ends - starts), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.read.schema(SEGMENT).parquet(path).mapInArrow(decode, schema)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files with the number of ids in front of it (``start``)."""
    segments = spark.read.schema(SEGMENT).parquet(path).select("part", "seq", "n_tokens")
    begins = running_start(segments, [], ["part", "seq"], {"begin": "n_tokens"}, "segments")
    found = read_token_files(spark, path).join(begins.drop("n_tokens"), ["part", "seq"])
    return found.select(
        "doc_id", (F.col("begin") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path)
    drop_at_exit(spark, path)
    return token_index(spark, path)

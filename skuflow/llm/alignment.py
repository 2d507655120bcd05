"""Operator 11: alignment of two tokenisers over a corpus.

Tokeniser A encodes a space and the text, B the text, to which it adds that space. Where a
token of A and one of B end on the same byte, the text is cut; the tokens between two cuts are
a group, and every A token of a group is linked to every B token of it. The count of a pair of
ids is the number of documents that hold it linked.

1. First pass: tasks align their documents and add up, for each distinct pair, the documents
   that hold it. Pairs are dealt to shards by their A id, so that a shard has all pairs of its
   A ids and at most ids of B for each, whatever the corpus: no key can fill a task.
2. Partial sums of a shard are merged in branches. From the shard's distinct pairs a minimal
   perfect hash is made; every branch writes its sums into a dense vector indexed by it, and
   the branches' vectors are added. A second vector has the highest count of each A id.
3. Second pass: tasks align the documents again and ask, for runs of documents, for the
   distinct pairs of each document. Requests go to copies of the tables they need, which
   compare the stored key with each key asked; the answers are sums for each document.

Alignment is done on the distinct units of a run of texts (``units``), since both tokenisers
end a token where a unit ends.

Defined results: texts that are null or empty, or that the tokens of A or B do not spell (such
as those with U+2581), have no tokens and all numbers 0; a long text is one document,
whatever its length, and pairs are expanded in bounded runs; rows that share a ``doc_id``, or
are equal, are documents of their own; of equal highest counts every pair is best; an empty
table gives no rows; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import buffers, chunks, documents, spans, texts
from skuflow.llm.byte_pairs import ByteDecoder
from skuflow.llm.perfect_hash import CountTable, PerfectHash
from skuflow.llm.pieces import Normaliser, piece_bytes, piece_encoder
from skuflow.llm.units import unit_offsets
from skuflow.llm.vocabularies import unit_encoder, vocabulary_of, vocabulary_path
from skuflow.session import stage

#: Ids of B take so many bits of a pair's key, ids of A the rest of 32.
B_BITS = 15
SHARDS, BRANCHES = 256, 16
#: Pairs that a task expands, or holds before it merges them, at once.
PAIRS_HELD = 2_000_000
#: Pairs of the tables that a task of the second pass holds.
TABLE_PAIRS = 1_000_000


def shard_of(keys: np.ndarray) -> np.ndarray:
    """Shard of each pair, by its A id."""
    return ((keys >> B_BITS).astype(np.int64) * 40503 & 0xFFFF) * SHARDS >> 16


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values[order], first)


def _by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each run of values between two ends."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])


@dataclass
class Aligned:
    """A run of texts: numbers and group strings of each, and its distinct pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    doc: np.ndarray  # of each distinct pair of a document, ascending
    key: np.ndarray
    links: np.ndarray  # how often the document has it


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self._a = unit_encoder(a_path, lower=False, leading_space=True, special_as_text=True)
        pieces = piece_encoder(b_path)
        self._b = pieces.units
        # Where the words of A end, B does too if none of its pieces goes on there.
        spelt = buffers(pa.array(piece_bytes(b_path), pa.binary()))
        inner = np.setdiff1d(unit_offsets(*spelt, True), spelt[1])
        self._cut = pieces.cuts_before_spaces and not len(inner)
        self._a_bytes = ByteDecoder.of_letters(vocabulary_of(a_path))
        self._b_bytes = ByteDecoder(piece_bytes(b_path))
        if len(self._b_bytes.lengths) > 1 << B_BITS:
            raise ValueError(f"B has more than {1 << B_BITS} ids")
        self._space = Normaliser(b"", dummy_prefix=True, squeeze=False)

    def clear(self) -> None:
        self._a.clear()
        self._b.clear()

    @staticmethod
    def _spelt(coder: ByteDecoder, parts: list[bytes], data: np.ndarray, at: np.ndarray):
        """Ids of the units, how many each has, the end of each id in ``data``, and which
        units the ids spell."""
        ids = np.frombuffer(b"".join(parts), "<u2").astype(np.int64)
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        lengths = coder.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        size = _by_text(lengths, ends)
        begin = np.cumsum(size) - size
        same = size == np.diff(at)
        written = coder.decode(ids)[spans(begin[same], size[same])]
        equal = written == data[spans(at[:-1][same], size[same])]
        same[same] = _by_text(~equal, np.concatenate([[0], np.cumsum(size[same])])) == 0
        stop = np.cumsum(lengths) + np.repeat(at[:-1] - begin, counts)
        return ids, counts, stop, same

    def align(self, texts: pa.Array) -> Aligned:
        n = len(texts)
        data, offsets, _ = self._space.batch(*buffers(texts))
        unit_at = unit_offsets(data, offsets, True) if self._cut else np.unique(offsets)
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(unit_at) - 1, [None, pa.py_buffer(unit_at.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode() if len(data) else pa.array([], pa.large_binary()).dictionary_encode()
        index = units.indices.to_numpy(zero_copy_only=False)
        values, at = buffers(units.dictionary)
        raw, bounds = values.tobytes(), at.tolist()
        listed = [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        a, a_n, a_end, a_same = self._spelt(self._a_bytes, self._a.ids_of(listed), values, at)
        b, b_n, b_end, b_same = self._spelt(self._b_bytes, self._b.ids_of(listed), values, at)
        right = a_same & b_same
        a_unit, b_unit = np.repeat(right, a_n), np.repeat(right, b_n)
        a, a_end, b, b_end = a[a_unit], a_end[a_unit], b[b_unit], b_end[b_unit]
        a_n, b_n = np.where(right, a_n, 0), np.where(right, b_n, 0)
        # Bytes where tokens of both end; the number of such bytes before a token's end.
        ends_a, ends_b = np.zeros(len(values) + 1, bool), np.zeros(len(values) + 1, bool)
        ends_a[a_end] = ends_b[b_end] = True
        cuts = np.cumsum(ends_a & ends_b)
        a_group, b_group = cuts[a_end - 1], cuts[b_end - 1]
        unit_groups = cuts[at]  # groups up to each unit's start, and after the last
        n_groups = int(cuts[-1])
        a_of = np.bincount(a_group, minlength=n_groups)
        b_of = np.bincount(b_group, minlength=n_groups)
        joined = pc.binary_join_element_wise(
            _lists(a, a_of, ","), _lists(b, b_of, ","), "|"
        )
        unit_text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(unit_groups, pa.int64()), joined), ";")
        unit_doc = np.searchsorted(offsets, unit_at[:-1], "right") - 1
        wrong = np.bincount(unit_doc[~right[index]], minlength=n) > 0
        doc_units = np.searchsorted(unit_at[:-1], offsets)  # where each text's units begin

        def of_docs(per_unit: np.ndarray) -> np.ndarray:
            return np.where(wrong, 0, _by_text(per_unit[index], doc_units))

        strings = pc.binary_join(
            pa.LargeListArray.from_arrays(pa.array(doc_units, pa.int64()), unit_text.take(pa.array(index))), ";"
        ).to_pylist()
        key, links, unit_of_pair = self._pairs(a, a_group, b, b_group, b_of, unit_groups)
        pair_at = np.searchsorted(unit_of_pair, np.arange(len(listed) + 1))
        seen, times = np.unique(unit_doc * max(1, len(listed)) + index, return_counts=True)
        seen_doc, seen_unit = seen // max(1, len(listed)), seen % max(1, len(listed))
        use = ~wrong[seen_doc]
        seen_doc, seen_unit, times = seen_doc[use], seen_unit[use], times[use]
        width = pair_at[seen_unit + 1] - pair_at[seen_unit]
        rows = spans(pair_at[seen_unit], width)
        doc_key, links = _sums(
            np.repeat(seen_doc, width) << 32 | key[rows], np.repeat(times, width) * links[rows]
        )
        return Aligned(
            of_docs(a_n), of_docs(b_n), of_docs(np.diff(unit_groups)),
            of_docs(_by_text(a_of * b_of, unit_groups)),
            ["" if w else s for w, s in zip(wrong.tolist(), strings, strict=True)],
            doc_key >> 32, (doc_key & 0xFFFFFFFF).astype(np.uint32), links,
        )

    @staticmethod
    def _pairs(a, a_group, b, b_group, b_of, unit_groups):
        """Distinct pairs of each unit with their links, ascending by unit."""
        one = np.ones(1, np.int64)
        ga, a_times = _sums(a_group << 16 | a, np.repeat(one, len(a)))
        gb, b_times = _sums(b_group << 16 | b, np.repeat(one, len(b)))
        b_first = np.searchsorted(gb >> 16, np.arange(len(b_of) + 1))
        group = ga >> 16
        width = b_first[group + 1] - b_first[group]
        unit = np.searchsorted(unit_groups, group, "right") - 1
        before = np.cumsum(width) - width
        keys, links = [], []
        first = 0
        while first < len(ga):  # in runs of bounded size, each reduced to distinct pairs
            last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS_HELD)))
            part = slice(first, last)
            rows = spans(b_first[group[part]], width[part])
            pair = np.repeat((unit[part] << 32) | ((ga[part] & 0xFFFF) << B_BITS), width[part])
            k, n = _sums(pair | (gb[rows] & 0xFFFF), np.repeat(a_times[part], width[part]) * b_times[rows])
            keys.append(k)
            links.append(n)
            first = last
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, links = _sums(np.concatenate(keys), np.concatenate(links))
        return key & 0xFFFFFFFF, links, key >> 32


def _lists(ids: np.ndarray, counts: np.ndarray, separator: str) -> pa.Array:
    """Runs of ids as text."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    numbers = pa.array(ids).cast(pa.string())
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), numbers), separator)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _aligned(batches, a_path: str, b_path: str) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Runs of rows, aligned, by the task that has them."""
    worker = aligner(a_path, b_path)
    try:
        for batch in batches:
            for part in chunks(batch):
                yield part, worker.align(part.column("text"))
    finally:
        worker.clear()


class _Held:
    """Sums of keys, in bounded memory where keys repeat."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._parts.append((keys, counts))
        self.size += len(keys)
        if self.size > PAIRS_HELD:
            self.take_in()

    def take_in(self) -> tuple[np.ndarray, np.ndarray]:
        if not self._parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        merged = _sums(*(np.concatenate(x) for x in zip(*self._parts, strict=True)))
        self._parts, self.size = [merged], len(merged[0])
        return merged

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.take_in()
        self._parts, self.size = [], 0
        return out


_COUNTS = "shard int, branch int, keys binary, counts binary"


def _sharded(branch: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    shard = shard_of(keys)
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    held = np.unique(shard)
    at = np.append(np.searchsorted(shard, held), len(shard)).tolist()
    runs = list(zip(at, at[1:], strict=False))
    return pa.RecordBatch.from_arrays([
        pa.array(held, pa.int32()), pa.array(np.full(len(held), branch), pa.int32()),
        pa.array([keys[i:j].astype("<u4").tobytes() for i, j in runs], pa.binary()),
        pa.array([counts[i:j].astype("<i8").tobytes() for i, j in runs], pa.binary()),
    ], names=["shard", "branch", "keys", "counts"])


def document_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """First pass: partial numbers of documents for each pair, in rows of a shard."""

    def count(batches):
        branch = TaskContext.get().partitionId() % BRANCHES
        held = _Held()
        for _, found in _aligned(batches, a_path, b_path):
            held.add(*_sums(found.key, np.ones(len(found.key), np.int64)))
            if held.size > PAIRS_HELD // 2:
                yield _sharded(branch, *held.empty())
        if held.size:
            yield _sharded(branch, *held.empty())

    return texts(docs).mapInArrow(count, _COUNTS)


def _groups(batches, *names: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that follow each other with equal ``names``, one row in memory at a time."""
    rows = (
        batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)
    )
    return groupby(rows, key=lambda r: tuple(r[n] for n in names))


def _ordered(df: DataFrame, *names: str) -> DataFrame:
    return df.repartition(*names).sortWithinPartitions(*names)


def _u4(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def _i8(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def count_tables(counts: DataFrame) -> DataFrame:
    """One row for each shard: its hash, its pairs in order of their numbers, their counts and
    the highest count of each pair's A id."""

    def merge(batches):
        for (shard, branch), rows in _groups(batches, "shard", "branch"):
            held = _Held()
            for r in rows:
                held.add(_u4(r["keys"]), _i8(r["counts"]))
            keys, total = held.empty()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "branch": branch, "keys": keys.tobytes(), "counts": total.tobytes()}],
                schema=pa.schema([("shard", pa.int32()), ("branch", pa.int32()),
                                  ("keys", pa.binary()), ("counts", pa.binary())]),
            )

    def hash_keys(batches):
        for (shard,), rows in _groups(batches, "shard"):
            held = _Held()
            for r in rows:
                keys = _u4(r["keys"])
                held.add(keys, np.ones(len(keys), np.int64))
            keys, _ = held.empty()
            hashed = PerfectHash.of(keys)
            stored = np.zeros(len(keys), "<u4")
            stored[hashed.numbers(keys)] = keys
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()),
                pa.array([[x.tobytes() for x in hashed.levels]], pa.list_(pa.binary())),
                pa.array([stored.tobytes()], pa.binary()),
            ], names=["shard", "levels", "stored"])

    def vectors(batches):
        for (shard,), rows in _groups(batches, "shard"):
            for r in rows:
                at = PerfectHash(r["levels"]).numbers(_u4(r["keys"]))
                vector = np.zeros(len(r["stored"]) // 4, "<i8")
                vector[at] = _i8(r["counts"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([vector.tobytes()], pa.binary())],
                    names=["shard", "vector"],
                )

    def add(batches):
        for (shard,), rows in _groups(batches, "shard"):
            total = None
            for r in rows:
                total = _i8(r["vector"]).copy() if total is None else total + _i8(r["vector"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                names=["shard", "counts"],
            )

    merged = stage(_ordered(counts, "shard", "branch").mapInArrow(merge, _COUNTS), "merged-pairs")
    hashed = stage(
        _ordered(merged.select("shard", "keys"), "shard")
        .mapInArrow(hash_keys, "shard int, levels array<binary>, stored binary"), "hashed-pairs",
    )
    dense = merged.join(hashed, "shard").mapInArrow(vectors, "shard int, vector binary")
    totals = _ordered(dense, "shard").mapInArrow(add, "shard int, counts binary")
    return stage(hashed.join(totals, "shard"), "pair-tables")


#: What the second pass knows of a document before its pairs are counted.
_BASE = np.dtype([
    ("known", "?"), ("doc_id", "<i8"), ("n_a", "<i8"), ("n_b", "<i8"), ("n_groups", "<i8"),
    ("n_links", "<i8"), ("spelt", "?"), ("sha", "S32"),
])
_REQUEST = (
    "part int, branch int, kind int, run string, docs binary, keys binary, links binary, base binary"
)
_ANSWER = (
    "run string, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "n_best long, count_sum long, groups_sha256 string"
)


def _requests(docs: DataFrame, a_path: str, b_path: str, parts: int, branches: int) -> DataFrame:
    """Second pass: the pairs of each document, by the part of the tables that has them."""
    names = [f.split()[0] for f in _REQUEST.split(", ")]

    def ask(batches):
        task = TaskContext.get().partitionId()
        for number, (part, found) in enumerate(_aligned(batches, a_path, b_path)):
            n = part.num_rows
            base = np.zeros(n, _BASE)
            ids = part.column("doc_id")
            base["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            base["doc_id"] = ids.fill_null(0).to_numpy()
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                base[name] = getattr(found, name)
            base["spelt"] = [x != "" for x in found.groups]
            digests = b"".join(hashlib.sha256(x.encode()).digest() for x in found.groups)
            base["sha"] = np.frombuffer(digests, "S32")
            place = shard_of(found.key) % parts
            rows = []
            for p in range(parts):
                at = np.flatnonzero(place == p)
                if not len(at) and p:
                    continue
                rows.append([
                    p, (task + number) % branches, 1, f"{task}-{number}",
                    found.doc[at].astype("<u4").tobytes(), found.key[at].astype("<u4").tobytes(),
                    found.links[at].astype("<i8").tobytes(), b"" if p else base.tobytes(),
                ])
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names,
            )

    return texts(docs).mapInArrow(ask, _REQUEST)


def _answers(batches) -> Iterator[pa.RecordBatch]:
    """Sums of each document over its pairs in the tables that precede the requests."""
    names = [f.split()[0] for f in _ANSWER.split(", ")]
    for _, rows in _groups(batches, "part", "branch"):
        tables: dict[int, CountTable] = {}
        for r in rows:
            if r["kind"] == 0:
                keys, counts = _u4(r["stored"]), _i8(r["counts"])
                a = (keys >> B_BITS).astype(np.int64)
                highest = np.zeros(int(a.max(initial=0)) + 1, np.int64)
                np.maximum.at(highest, a, counts)
                tables[r["shard"]] = CountTable(r["levels"], keys, counts, highest[a])
                continue
            doc, keys, links = _u4(r["docs"]).astype(np.int64), _u4(r["keys"]), _i8(r["links"])
            shard = shard_of(keys)
            order = np.argsort(shard, kind="stable")
            count, highest = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            ends = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            for k, table in tables.items():
                at = order[ends[k]:ends[k + 1]]
                count[at], highest[at] = table.look_up(keys[at])
            base = np.frombuffer(r["base"], _BASE)
            n = max(len(base), int(doc.max(initial=-1)) + 1)
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(best, doc, np.where(count == highest, links, 0))
            np.add.at(total, doc, links * count)
            here = np.arange(n) if len(base) else np.unique(doc)
            first = {
                name: pa.array(base[name], pa.int64()) if len(base) else pa.nulls(len(here), pa.int64())
                for name in ("n_a", "n_b", "n_groups", "n_links")
            }
            ids = pa.nulls(len(here), pa.int64()) if not len(base) else pa.array(
                base["doc_id"], pa.int64(), mask=~base["known"])
            sha = [None] * len(here) if not len(base) else [
                x.ljust(32, b"\0").hex() if spelt else ""
                for x, spelt in zip(base["sha"].tolist(), base["spelt"].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["run"]] * len(here), pa.string()), pa.array(here, pa.int32()), ids,
                *first.values(), pa.array(best[here]), pa.array(total[here]), pa.array(sha, pa.string()),
            ], names=names)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: its tokens, groups and links, and what the corpus-wide counts
    of its pairs give."""
    spark = docs.sparkSession
    counts = stage(document_counts(docs, a_path, b_path), "pair-counts")
    tables = count_tables(counts)
    pairs = tables.agg(F.sum(F.octet_length("stored"))).first()[0] or 0
    parts = min(SHARDS, max(1, -(-(pairs // 4) // TABLE_PAIRS)))
    branches = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    copies = tables.select(
        (F.col("shard") % parts).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch"),
        F.lit(0).alias("kind"), "shard", "levels", "stored", "counts",
    )
    asked = _requests(docs, a_path, b_path, parts, branches)
    answered = (
        copies.unionByName(asked, allowMissingColumns=True)
        .repartition("part", "branch").sortWithinPartitions("part", "branch", "kind")
        .mapInArrow(_answers, _ANSWER)
    )
    names = [f.split()[0] for f in _ANSWER.split(", ")]
    own = [F.max(c).alias(c) for c in names if c not in ("run", "doc", "n_best", "count_sum")]
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    return answered.groupBy("run", "doc").agg(*own, *sums).select(*names[2:])


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(
        documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"),
        vocabulary_path("piece_bpe_32k.model"),
    )

"""Operator 13: the best documents for each item of a query set, by hashed max-sketches.

An item's score of a document sums, over the item's distinct terms, the impact of the term
there: its weight times a share of 1,000,000 that grows with how often it occurs and falls
with the document's length. Items are taken in blocks of bounded text. For a block

1. one pass over all texts stores of each document its length and the occurrences of the
   terms that the block asks (no other term can add to a score); sums over that table give
   the numbers of documents, of terms, and of documents for each term;
2. each task reads documents in runs and folds their impacts into a sketch: a term hashes to
   a coordinate, which holds the greatest impact of the document's terms there. All items of
   the block look up their terms' coordinates in all sketches of the run at once, and the sum
   is at least the score. For each item, documents are then scored exactly in falling order
   of this bound, until it is below the tenth best score that the task has found so far;
3. what is left, ten documents for each item and task at most, is merged in two steps.

So no document is skipped that could enter an item's list: its bound would be high enough.

Defined results: null and empty texts, and texts without terms, count nowhere and are never
found; a long text is one document, whatever its length; equal scores are ranked by ascending
``doc_id``, null ids last; rows that share a ``doc_id``, or are equal, are documents of their
own and take a rank each; rows of equal ``item_id`` are items of their own, and items without
terms have no results; an empty table on either side gives no rows; other columns are
ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.llm.base import buffers, chunks, documents, running_start, ship, spans, texts
from skuflow.session import stage

K = 10
COORDINATES = 1024
#: Text of the items that are searched for at once.
BLOCK_BYTES = 1 << 20
#: Documents whose sketches a task holds at once.
RUN = 1024
#: Documents scored before the bound is compared with the threshold again.
STEP = 32

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def term_units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Texts cut where terms begin and end: the pieces, which of them are terms, and the text
    that each belongs to. A-Z is lower-cased."""
    data, offsets = buffers(texts)
    if not len(data):
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(0, bool), np.zeros(0, np.int64)
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    term = _TERM[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = term[1:] != term[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]
    )
    text = np.searchsorted(offsets, at[:-1], "right") - 1
    return pieces.dictionary_encode(), term[at[:-1]], text


@dataclass
class Block:
    """Items searched for at once: their terms as numbers into ``terms``."""

    terms: list[bytes]
    numbers: list[int]  # of the items
    wanted: list[np.ndarray]  # of each item, the numbers of its terms
    coordinate: np.ndarray  # of each term in a sketch

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        pieces, is_term, text = term_units(pa.array([t for _, t in rows], pa.string()))
        used = pieces.filter(pa.array(is_term)).to_pylist()
        place = {t: i for i, t in enumerate(sorted(set(used)))}
        of_item: dict[int, set[int]] = {}
        for k, t in zip(text[is_term].tolist(), used, strict=True):
            of_item.setdefault(k, set()).add(place[t])
        held = sorted(of_item)
        return cls(
            list(place), [rows[k][0] for k in held],
            [np.array(sorted(of_item[k]), np.int64) for k in held],
            np.array([xxhash.xxh64_intdigest(t) % COORDINATES for t in place], np.int64),
        )


def occurrences(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Documents with a term at all: ``doc_id``, how many terms (``n``), and which of
    ``terms`` occur (``at``, their numbers) how often (``tf``)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # those of a block's items

    def count(batches):
        asked = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for part in chunks(batch):
                pieces, is_term, text = term_units(part.column("text"))
                known = pc.index_in(pieces.dictionary, asked).fill_null(-1).to_numpy()
                number = known[pieces.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
                n = np.bincount(text[is_term], minlength=part.num_rows)
                found = is_term & (number >= 0)
                key, tf = np.unique(text[found] * len(asked) + number[found], return_counts=True)
                doc = key // max(1, len(asked))
                keep = n > 0
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                offsets = pa.array(np.append(ends[:-1][keep], ends[-1]), pa.int32())
                at = (key - doc * len(asked)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").filter(pa.array(keep)), pa.array(n[keep], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(at)),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                ], names=["doc_id", "n", "at", "tf"])

    return texts(docs).mapInArrow(count, "doc_id long, n long, at array<int>, tf array<long>")


def _scaled_lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's ``m``; in Python's integers where 64 bits are too few."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // n_terms


class Impacts:
    """The impacts of a run of documents: by document, and folded into sketches."""

    def __init__(self, offsets: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.offsets, self.at, self.value = offsets, at, value

    def sketches(self, coordinate: np.ndarray) -> np.ndarray:
        """Coordinates by documents: the greatest impact folded there."""
        size = len(self.offsets) - 1
        doc = np.repeat(np.arange(size), np.diff(self.offsets))
        out = np.zeros(COORDINATES * size, np.int64)
        np.maximum.at(out, coordinate[self.at] * size + doc, self.value)
        return out.reshape(COORDINATES, size)

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores; ``wanted`` tells for each term whether it counts."""
        lengths = self.offsets[docs + 1] - self.offsets[docs]
        rows = spans(self.offsets[docs], lengths)
        sums = np.concatenate([[0], np.cumsum(np.where(wanted[self.at[rows]], self.value[rows], 0))])
        ends = np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]


class Best:
    """The best documents of one item so far."""

    def __init__(self):
        self.score, self.key = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    @property
    def threshold(self) -> int:
        """A document below this cannot enter; 1 while there is room."""
        return int(self.score[-1]) if len(self.score) == K else 1

    def add(self, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.score, score]), np.concatenate([self.key, key])
        order = np.lexsort([key[:, 1], key[:, 0], -score])
        order = order[score[order] > 0][:K]
        self.score, self.key = score[order], key[order]


def search_run(impacts: Impacts, key: np.ndarray, block: Block, best: list[Best]) -> int:
    """Bring the documents of a run into the items' lists; returns how many were scored.

    ``key`` has (id is null, id) of each document.
    """
    sketch = impacts.sketches(block.coordinate)
    counts_for = np.zeros(len(block.terms), bool)
    scored = 0
    for wanted, top in zip(block.wanted, best, strict=True):
        places, times = np.unique(block.coordinate[wanted], return_counts=True)
        bound = (sketch[places] * times[:, None]).sum(axis=0)
        order = np.flatnonzero(bound >= top.threshold)
        order = order[np.argsort(-bound[order], kind="stable")]
        counts_for[wanted] = True
        for first in range(0, len(order), STEP):
            some = order[first:first + STEP]
            if bound[some[0]] < top.threshold:
                break
            top.add(impacts.scores(some, counts_for), key[some])
            scored += len(some)
        counts_for[wanted] = False
    return scored


def _search_block(found: DataFrame, block: Block, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Up to ten documents for each item and task."""
    shared = found.sparkSession.sparkContext.broadcast((block, weights))

    def search(batches) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        best = [Best() for _ in block.numbers]
        for batch in batches:
            for first in range(0, batch.num_rows, RUN):
                part = batch.slice(first, RUN)
                ids = part.column("doc_id")
                key = np.stack([
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                    ids.fill_null(0).to_numpy(),
                ], 1)
                lists = part.column("at")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                at = lists.values.to_numpy()[offsets[0]:offsets[-1]]
                tf = part.column("tf").flatten().to_numpy()
                offsets = offsets - offsets[0]
                m = _scaled_lengths(part.column("n").to_numpy(), n_docs, n_terms)
                m = np.repeat(m, np.diff(offsets))
                value = weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                search_run(Impacts(offsets, at, value), key, block, best)
        rows = [(n, s, *k) for n, b in zip(block.numbers, best, strict=True)
                for s, k in zip(b.score.tolist(), b.key.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([None if r[2] else r[3] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
        ], names=["_item", "doc_id", "score"])

    return found.mapInArrow(search, "_item long, doc_id long, score long")


def _best_rows(rows: DataFrame, *group: str) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= K)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the best documents of each item."""
    spark = docs.sparkSession
    ship(spark)
    asked = items.select(
        items["item_id"].alias("item_id"),
        F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_item"),
    )
    asked = stage(asked.withColumn("_size", F.octet_length("text").cast("long")), "items")
    places = running_start(asked.select("_item", "_size"), [], ["_item"], {"_before": "_size"}, "item-places")
    blocked = asked.join(
        places.select("_item", F.floor(F.col("_before") / BLOCK_BYTES).cast("long").alias("_block")), "_item"
    )
    blocked = stage(blocked, "item-blocks")
    last = blocked.agg(F.max("_block")).first()[0]
    parts = []
    for number in range(0 if last is None else last + 1):
        # At most BLOCK_BYTES of text and one item more.
        rows = blocked.where(F.col("_block") == number).select("_item", "text").collect()
        block = Block.of(sorted((r["_item"], r["text"]) for r in rows))
        if not block.numbers:
            continue
        found = stage(occurrences(docs, block.terms), "term-occurrences")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(block.terms), np.int64)
        held = found.select(F.explode("at").alias("at")).groupBy("at").count()
        for r in held.collect():  # one row for each term of the block's items
            df[r["at"]] = r["count"]
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        local = _search_block(found, block, weights, n_docs, n_terms or 1)
        # Lists of many tasks are merged in shares before all of an item meet.
        share = local.withColumn("_share", F.spark_partition_id() % 64)
        parts.append(_best_rows(share, "_item", "_share").drop("rank", "_share"))
    empty = spark.createDataFrame([], "_item long, doc_id long, score long")
    rows = empty
    for part in parts:
        rows = rows.unionByName(part)
    return _best_rows(rows, "_item").join(asked.select("_item", "item_id"), "_item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), q as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), total as (
  select count(*) as big_n, sum(len(terms))::bigint as big_l from d where len(terms) > 0
), tf as (
  select doc_id, len(terms)::bigint as n, term, count(*)::bigint as tf
  from (select doc_id, terms, unnest(terms) as term from d)
  where term in (select term from q)
  group by doc_id, terms, term
), w as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, total group by term, big_n
), scored as (
  select q.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf)
    // (1000 * tf.tf + 8 * (100 - 90 + (90 * tf.n * big_n) // big_l))))::bigint as score
  from q join tf using (term) join w using (term), total
  group by q.item_id, tf.doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank,
    doc_id, score
  from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

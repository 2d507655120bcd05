"""Operator 6: SimHash near-duplicates through a byte-position index.

Fingerprints of 64 bits are eight bytes, one for each position. Three differing bits touch
at most three bytes, so linked fingerprints share at least five positional bytes. Of any
five positions three lie in the same half, so the postings are kept for the eight triples
inside the halves: linked fingerprints meet in at least one posting list. For each pair
that meets, the shared positional bytes are tallied; pairs with fewer than five go, the
rest are verified by their distance.

Equal fingerprints are one entry with many members. A long posting list is dealt to many
tasks as pairs of blocks, and a task hands on only links that join something new in it, so
a group of n near copies gives about n links, never all pairs.

Defined results: a null text is empty; texts without words have fingerprint zero; texts of
one or two words have a single shingle; rows that share a ``doc_id`` are members of their
own; a null ``doc_id`` counts only where no other member has one; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.llm.base import documents, texts, whole_text, word_list
from skuflow.llm.components import components
from skuflow.llm.simhash_bits import fingerprint, hex16, vote_sums
from skuflow.session import stage

SHINGLE_WORDS = 3
MAX_BITS = 3
BYTES = 8
#: Fingerprints of a posting list that a task takes against as many others.
BLOCK = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, a hash ``h`` of the text and the fingerprint of each whole text, as
    signed 64-bit numbers.

    A text's shingles are hashed and added up in the task that read it; what is shuffled is
    one row of sums for each text.
    """
    words = texts(docs).select(
        "doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("_row"),
        word_list(lower_ascii(F.col("text"))).alias("words"),
    )
    w = F.col("words")
    n = F.size(w)
    shingles = F.when(n == 0, F.array().cast("array<string>")).when(
        n <= width, F.array(F.array_join(w, " "))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(1), n - (width - 1)),
            lambda i: F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(width)]),
        )
    )
    hashes = words.select("doc_id", "h", "_row", F.explode_outer(shingles).alias("s")).select(
        "doc_id", "h", "_row",
        F.when(F.col("s").isNotNull(), F.xxhash64("s")).otherwise(F.lit(0)).alias("_h"),
        F.when(F.col("s").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("_w"),
    )
    return (
        hashes.groupBy("_row", "doc_id", "h").agg(*vote_sums("_h", "_w"), F.sum("_w").alias("_total"))
        .select("doc_id", "h", fingerprint("_total").alias("fp"))
    )


def _triples() -> list[tuple[int, ...]]:
    half = BYTES // 2
    return [*combinations(range(half), 3), *combinations(range(half, BYTES), 3)]


def postings(distinct: DataFrame) -> DataFrame:
    """``key`` (which triple of positions, and its bytes) and ``fp`` for each entry."""
    keys = []
    for t, places in enumerate(_triples()):
        key = F.lit(t).cast("long")
        for p in places:
            byte = F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _close_pairs(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes and then lie within the distance."""
    x = a ^ b
    shared = np.zeros(x.shape, np.uint8)
    for p in range(BYTES):
        shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    keep = shared >= BYTES - bits
    keep[keep] = np.bitwise_count(x[keep]) <= bits
    return keep


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the links of one block pair: each member with the smallest it reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _links_of_group(fps: np.ndarray, sides: np.ndarray, bits: int):
    """Links inside a block (one side) or between two blocks."""
    left, right = fps[sides == 0], fps[sides == 1]
    if not len(right):
        right = left
    found_a, found_b = [], []
    step = max(1, (1 << 19) // max(1, len(right)))
    for i in range(0, len(left), step):
        rows = left[i:i + step]
        keep = _close_pairs(rows[:, None], right[None, :], bits)
        x, y = np.nonzero(keep)
        a, b = rows[x], right[y]
        new = a != b
        if new.any():
            a, b = _forest(a[new], b[new])
            found_a.append(a)
            found_b.append(b)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def _small_groups(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int):
    """Links inside many small groups at once, by the distance of members in the list."""
    group = np.repeat(np.arange(len(starts)), sizes)
    out_a, out_b = [], []
    for lag in range(1, int(sizes.max()) if len(sizes) else 0):
        same = group[lag:] == group[:-lag]
        a, b = fps[:-lag][same], fps[lag:][same]
        keep = _close_pairs(a, b, bits)
        out_a.append(a[keep])
        out_b.append(b[keep])
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


_SMALL = 32


def _link_batches(batches, bits: int):
    """Rows (key, i, j, side, fp) in order of (key, i, j): links of each group."""
    rest = None

    def work(table):
        cols = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        fps = table.column("fp").to_numpy().view(np.uint64)
        sides = table.column("side").to_numpy()
        new = np.zeros(len(fps), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        small = sizes <= _SMALL
        pick = np.repeat(small & (sizes > 1), sizes)
        parts = []
        if pick.any():
            kept = sizes[small & (sizes > 1)]
            parts.append(_small_groups(fps[pick], np.cumsum(kept) - kept, kept, bits))
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            parts.append(_links_of_group(fps[s:s + n], sides[s:s + n], bits))
        a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    def joined(a, b):
        return pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if rest is None else joined(rest, batch)
        last = [table.column(c)[table.num_rows - 1].as_py() for c in ("key", "i", "j")]
        mask = np.ones(table.num_rows, bool)
        for c, v in zip(("key", "i", "j"), last, strict=True):
            mask &= table.column(c).to_numpy() == v
        open_from = int(np.flatnonzero(mask)[0])  # the last group may go on in the next batch
        if open_from:
            yield work(table.slice(0, open_from))
        rest = table.slice(open_from)
    if rest is not None:
        yield work(rest)


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints within the distance of each other.

    ``distinct`` has each fingerprint once as ``fp``.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the triples of positions cover distances up to 3")
    listed = postings(distinct)
    sizes = listed.groupBy("key").count().where("count > 1").select(
        F.col("key").alias("_k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = listed.join(sizes, F.col("key") == F.col("_k")).withColumn("block", block)
    # A fingerprint of block x goes to the block pairs (x, y) and (y, x) of its list.
    pairs = met.select(
        "key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = pairs.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "fp",
    )
    found = (
        dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        .mapInArrow(lambda batches: _link_batches(batches, bits), "a long, b long")
    )
    return found.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS
) -> DataFrame:
    """Each document's ``doc_id``, text hash ``h``, fingerprint ``fp``, the smallest ``doc_id``
    that links reach (``component_id``), and whether its (``doc_id``, ``h``) is the group's
    first (``first``)."""
    prints = stage(fingerprints(docs, width), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    members = stage(prints.groupBy("fp").agg(F.min(order).alias("low")), "distinct-prints")
    roots = components(stage(links(members.select("fp"), bits), "links"))
    rooted = members.join(roots, members["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("low"))
    by_print = rooted.drop("low").join(lowest, "root").select("fp", "low")
    return prints.join(by_print, "fp").select(
        "doc_id", "h", "fp", F.col("low.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("h") == F.col("low.h"))).alias("first"),
    )


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """Documents without near duplicates: of each group the one with the smallest id, once."""
    first = near_duplicates(docs, width, bits).where("first").select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h")
    ).distinct()
    text = whole_text(docs)
    rows = docs.select(F.struct("*").alias("_doc"), docs["doc_id"].cast("long").alias("_d"), F.xxhash64(text).alias("_t"))
    kept = rows.join(first, rows["_d"].eqNullSafe(first["_id"]) & (rows["_t"] == first["_h"]))
    once = F.row_number().over(Window.partitionBy("_d", "_t").orderBy("_t"))
    return kept.withColumn("_n", once).where("_n = 1").select("_doc.*")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id"
    )

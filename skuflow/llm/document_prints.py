"""Operator 3: weighted SimHash fingerprints of documents, in DataFrame operations only.

Terms are pairs of neighbouring words (a single word stands alone), weighted by their
length in characters. Each term's hash votes its weight for or against every bit; the sign
of the sum is the bit. To find all fingerprints within a Hamming radius, the bits are cut
into blocks and permuted so that every choice of blocks leads a table once; near
fingerprints agree on the leading blocks of at least one table.

Defined results: a null text is empty and has fingerprint zero; rows that share a
``doc_id`` are ordered by a hash of their texts, equal rows follow each other; of an only
row the next document is itself; null ids come last in descending order; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.llm.base import documents, whole_text, word_list
from skuflow.llm.simhash_bits import BITS, fingerprint, hex16, vote_sums
from skuflow.session import stage

#: Radius of the search, and blocks that the bits are cut into: pairs within the radius
#: agree on all blocks but three.
RADIUS, BLOCKS = 3, 6
QUERY_EVERY = 50
#: Slices of the document order for each shuffle partition, so that partitions, which get
#: slices by hash, hold about equally many.
SLICES_EACH = 4


def _terms(words: Column) -> Column:
    def pairs(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 2)),
            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)),
        )

    found = F.transform(F.array(words), pairs)[0]
    return F.when(F.size(words) > 0, found)


def simhash(df: DataFrame, text: str, keep: list[str], column: str = "fp") -> DataFrame:
    """``keep`` columns, which tell rows apart, and the fingerprint of each row's text.

    If ``df`` is already dealt out by some of ``keep``, nothing is shuffled; otherwise one
    row of sums for each text is.
    """
    rows = df.select(*keep, word_list(F.col(text)).alias("_w"))
    votes = rows.select(*keep, F.explode_outer(_terms(F.col("_w"))).alias("_t")).select(
        *keep, F.coalesce(F.xxhash64("_t"), F.lit(0)).alias("_h"),
        F.coalesce(F.char_length("_t"), F.lit(0)).cast("long").alias("_weight"),
    )
    summed = votes.groupBy(*keep).agg(
        *vote_sums("_h", "_weight"), F.sum("_weight").alias("_total")
    )
    return summed.select(*keep, fingerprint("_total").alias(column))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def _blocks() -> list[tuple[int, int]]:
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(edges, [b - a for a, b in zip(edges, edges[1:], strict=False)], strict=False))


def block_tables(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint once in every table: ``table`` and the leading blocks as ``lead``."""
    cuts = _blocks()
    entries = []
    for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - radius)):
        lead = F.lit(0).cast("long")
        for b in chosen:
            shift, width = cuts[b]
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            lead = F.shiftleft(lead, width).bitwiseOR(part)
        entries.append(F.struct(F.lit(t).alias("table"), lead.alias("lead")))
    return prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.*")


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``q``, ``fp`` of a query and a fingerprint within the radius.

    Both tables hold each fingerprint once. A pair is kept only once verified, before it
    leaves the join.
    """
    left = block_tables(queries, radius).withColumnRenamed("fp", "q")
    right = block_tables(prints, radius)
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    on = (left["table"] == right["table"]) & (left["lead"] == right["lead"]) & near
    return left.join(right, on).select("q", "fp").distinct()


def _ranges(base: DataFrame) -> DataFrame:
    """Slices of the document order, about equal in rows: number ``part``, least and largest
    key, and ``target``, the slice whose last row in descending order ``top`` follows."""
    n = SLICES_EACH * int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = base.select("doc_id", "h").repartitionByRange(n, "doc_id", "h")
    key = F.struct("doc_id", "h")
    found = keys.groupBy(F.spark_partition_id().alias("s")).agg(
        F.min(key).alias("least"), F.max(key).alias("top")
    )
    # The windows without partitions have one row for each slice.
    part = found.withColumn("part", F.row_number().over(Window.orderBy("s")) - 1)
    target = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.lit(0))
    return stage(part.select("part", "least", "top", target.alias("target")), "document-slices")


def _part(ranges: DataFrame) -> Column:
    """The row's slice, found by the least keys of all slices (one for each slice) in two
    steps: among every k-th of them, then among the k from there."""
    starts = [
        (r["least"]["doc_id"], r["least"]["h"]) for r in ranges.orderBy("part").collect()
    ]
    if not starts:
        return F.lit(0)
    k = max(1, math.isqrt(len(starts)))
    key = F.struct(F.col("doc_id"), F.col("h"))

    def array(some: list) -> Column:
        return F.array(*[
            F.struct(F.lit(i).cast("long").alias("doc_id"), F.lit(h).cast("long").alias("h"))
            for i, h in some
        ])

    before = (F.size(F.filter(array(starts[::k]), lambda low: low <= key)) - 1) * k
    near = F.slice(array(starts), before + 1, k)
    return before + F.size(F.filter(near, lambda low: low <= key)) - 1


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Every document with its own, its edited text's and the next document's fingerprint.

    Whole texts are shuffled once, to slices of the document order. A slice finds its next
    texts itself; what follows its last row is the first row of the slice below, which is
    sent there too: one text for each slice. The votes are counted where the texts are.
    """
    text = whole_text(docs)
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.xxhash64(text, docs["doc_id"].isNull()).alias("h"), text.alias("text"),
    )
    ranges = _ranges(base)
    tops = ranges.select(
        F.col("top.doc_id").alias("t_id"), F.col("top.h").alias("t_h"),
        F.col("target").alias("part"),
    )
    sent = base.join(
        F.broadcast(tops),  # one row for each slice
        base["doc_id"].eqNullSafe(tops["t_id"]) & (base["h"] == tops["t_h"]),
    ).groupBy("part", "doc_id", "h").agg(F.first("text").alias("text"))
    both = base.select(
        _part(ranges).alias("part"), F.lit(False).alias("sent"), "doc_id", "h", "text"
    ).union(sent.select("part", F.lit(True), "doc_id", "h", "text"))
    order = Window.partitionBy("part").orderBy("sent", F.desc_nulls_last("doc_id"), F.desc("h"))
    n = F.char_length("text")
    k = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - k), F.left("next", k))

    def version(flag: bool, of: str) -> Column:
        return F.struct(F.lit(flag).alias("is_edited"), F.col(of).alias("t"))

    keep = ["part", "place", "sent", "doc_id", "n_chars", "edited_sha256"]
    versions = (
        both.withColumns({"place": F.row_number().over(order), "next": F.lead("text").over(order)})
        .select("part", "place", "sent", "doc_id", n.cast("long").alias("n_chars"), "text",
                F.when(~F.col("sent"), edited).alias("edited"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .select(*keep, F.explode(
            F.when(F.col("sent"), F.array(version(False, "text")))
            .otherwise(F.array(version(False, "text"), version(True, "edited")))
        ).alias("v"))
        .select(*keep, "v.*")
    )
    prints = simhash(versions, "t", [*keep, "is_edited"]).groupBy(*keep).agg(
        F.max(F.when(~F.col("is_edited"), F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("is_edited"), F.col("fp"))).alias("edited_fp"),
    )
    following = F.lead("fp").over(Window.partitionBy("part").orderBy("place"))
    return prints.withColumn("next_fp", following).where(~F.col("sent")).select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"
    )


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ``n_near`` for documents whose id is divisible by 50: how many other documents
    have a fingerprint within the radius."""
    found = stage(fingerprint_documents(documents(spark, sf_dir)), "fingerprints")
    prints = found.groupBy("fp").agg(F.count("*").alias("members"))
    queries = found.where(F.col("doc_id") % QUERY_EVERY == 0).select("fp").distinct()
    near = near_fingerprints(queries, prints.select("fp")).join(prints, "fp")
    counts = near.groupBy("q").agg((F.sum("members") - 1).alias("n"))
    asked = found.join(counts, found["fp"] == counts["q"], "left")
    return asked.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % QUERY_EVERY == 0, F.col("n")).alias("n_near"),
    )

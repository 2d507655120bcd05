"""Operator 7: shards from a hierarchical weighted hash tree.

A document descends from the root through regions and racks to a shard. At each level
every child draws ``ln(u) / weight`` with u a hash of (child, doc_id) in (0, 1), and the
highest draw wins: children win in proportion to their weights, and a changed weight
changes only the draws of that child, so documents move only into or out of the subtree
whose weight changed. A new shard opens a region of its own, hence takes documents from
others and moves none between them.

Defined results: a null ``doc_id`` counts as the text ``null``; rows that share a ``doc_id``
share a shard and have slots of their own; a null text has 16 bytes and the CRC-32 of the
empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.base import documents, running_start

SHARDS = 40
#: Racks in a region and shards in a rack of the first layout.
RACKS, RACK_SHARDS = 2, 5
ROW_BYTES = 16
_HEX = 12  # hex digits of a draw: 48 bits, exact as a double

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def shard_tree(shards: int, first: int = SHARDS) -> Tree:
    """Region -> rack -> shard -> weight. The first ``first`` shards fill racks and
    regions; each later one is a region of its own."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        if s < first:
            rack = s // RACK_SHARDS
            region = tree.setdefault(f"region{rack // RACKS}", {})
            region.setdefault(f"rack{rack}", {})[s] = 1.0
        else:
            tree[f"added{s}"] = {f"added-rack{s}": {s: 1.0}}
    return tree


def weight_of(node) -> float:
    """Weight of a subtree: the sum of its shards' weights."""
    return sum(map(weight_of, node.values())) if isinstance(node, Mapping) else float(node)


def _children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """Name of each inner node -> (child name, weight); shards are named by number."""
    out = {"root": [(name, weight_of(node)) for name, node in tree.items()]}
    for region, racks in tree.items():
        out[region] = [(name, weight_of(node)) for name, node in racks.items()]
        for rack, shards in racks.items():
            out[rack] = [(str(s), weight) for s, weight in shards.items()]
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a document by three draws; ``key`` is its id as text."""
    entry = "array<struct<name:string,weight:double>>"
    nodes: list[Column] = []
    for name, children in _children(tree).items():
        listed = F.array(*[
            F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in children
        ])
        nodes += [F.lit(name), listed.cast(entry)]
    table = F.create_map(*nodes)

    def draw(child: Column) -> Column:
        text = F.concat(child["name"], F.lit("/"), key)
        digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10)
        u = (digits.cast("double") + 0.5) / float(16**_HEX)
        return F.struct((F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node = F.lit("root")
    for _ in range(3):
        node = F.array_max(F.transform(F.element_at(table, node), draw))["name"]
    return node.cast("int")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its size, its shard, its slot there and its shard when one more
    is added.

    Texts are reduced to size and checksum before anything is shuffled. Slots follow
    (doc_id, size, checksum); a shard of any size is numbered over many tasks.
    """
    text = docs["text"].cast("string")
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, shard_tree(shards)).alias("shard"),
        shard_of(key, shard_tree(shards + 1, first=shards)).alias("grown_shard"),
        F.lit(1).alias("_one"),
    )
    order = ["doc_id", "size", "text_crc32"]
    return running_start(rows, ["shard"], order, {"slot": "_one"}, "shards").drop("_one")


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir))

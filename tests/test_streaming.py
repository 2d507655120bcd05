from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skuflow.operators import edits as E
from skuflow.schemas import CATALOGUE, EDITS, HIERARCHY, STAGING
from skuflow.sources.tables import commit, read_table, versions
from skuflow.streaming.edits import stream_changes, stream_edits
from tests.helpers import catalogue, edits, hierarchy, pick, staging
from tests.test_edits import _random_batch


def test_stream_of_edits(spark, tmp_path):
    root, inbox = str(tmp_path / "tables"), str(tmp_path / "inbox")
    commit(spark, root, {
        "catalogue": catalogue(spark, [{"id": 1, "marketplace_sku": "S1", "im_sku": "X"}, {"id": 2, "marketplace_sku": "S2", "im_sku": "X"}]),
        "staging": staging(spark, []), "hierarchy": hierarchy(spark, []),
    })

    def send(*rows):
        edits(spark, rows).coalesce(1).write.mode("append").parquet(inbox)

    def run(checkpoint):
        source = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(inbox)
        stream_edits(source, root, str(tmp_path / checkpoint)).awaitTermination()

    send({"edit_seq": 1, "id": 1, "marketplace_sku": "S1", "im_sku": "X", "parent_sku": "P1"})
    run("a")
    assert versions(spark, root) == [1, 2]
    assert pick(read_table(spark, root, "catalogue"), "id", "parent_sku") == [(1, "P1"), (2, "P1")]

    send({"edit_seq": 2, "id": 2, "marketplace_sku": "S2", "im_sku": "X", "parent_sku": "P2"}, {"edit_seq": 3, "id": 9, "region": "FR"})
    run("a")
    assert pick(read_table(spark, root, "catalogue"), "id", "parent_sku") == [(1, "P2"), (2, "P2")]
    assert pick(read_table(spark, root, "staging"), "id", "parent_sku") == [(1, "P1"), (2, "P2")]
    assert pick(read_table(spark, root, "rejects"), "edit_seq", "reason") == [(3, "no_company")]

    # Lost between the snapshot and the stream's own commit: the batch runs again.
    for name in ("1", ".1.crc"):
        (tmp_path / "a" / "commits" / name).unlink()
    run("a")
    assert versions(spark, root) == [1, 2, 3]

    # A new checkpoint is a new stream: batch numbers start over, nothing is skipped.
    run("b")
    assert versions(spark, root) == [1, 2, 3, 4, 5]


class _Store:
    """Tables that take changed rows in place: new versions of them, written by themselves."""

    def __init__(self, folder, **tables):
        self.folder, self.number, self.seen, self.sizes = folder, 0, [], []
        self.put(tables)

    def put(self, tables):
        self.number += 1
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{self.number}/{name}")

    def get(self, spark, name):
        return spark.read.parquet(f"{self.folder}/{self.number}/{name}")

    def read(self, spark):
        return self.get(spark, "catalogue"), self.get(spark, "staging")

    def write(self, changes, txn):
        if txn in self.seen:
            return
        self.seen.append(txn)
        spark = changes.catalogue.sparkSession
        self.sizes.append(tuple(df.count() for df in changes[:3]))
        parents = changes.hierarchy.select("im_sku", F.struct("parent_sku").alias("new"))
        held = self.get(spark, "hierarchy").join(parents, "im_sku", "left")
        taken = F.when(F.col("new").isNotNull(), F.col("new.parent_sku")).otherwise(F.col("parent_sku"))
        self.put({
            "catalogue": E.untouched(self.get(spark, "catalogue"), changes.catalogue).unionByName(changes.catalogue),
            "staging": E.untouched(self.get(spark, "staging"), changes.staging).unionByName(changes.staging),
            "hierarchy": held.withColumn("parent_sku", taken).select(*HIERARCHY.names),
        })


def _unstamped(df, schema):
    return pick(df, *[c for c in schema.names if c not in ("created_at", "updated_at")])


@pytest.mark.parametrize("per_batch", [2])
def test_stream_of_changes_is_that_of_one_batch(spark, tmp_path, per_batch):
    table, staged, held, batch = _random_batch(random.Random(3), list(range(1, 15)), 5)
    given = catalogue(spark, table), staging(spark, staged), hierarchy(spark, held)
    for row in batch:
        edits(spark, [row]).coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
    store = _Store(tmp_path / "store", catalogue=given[0], staging=given[1], hierarchy=given[2])
    source = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "inbox"))
    stream_changes(source, store.read, store.write, str(tmp_path / "check")).awaitTermination()
    assert len(store.seen) == -(-len(batch) // per_batch)
    want = E.apply_edits(*given, edits(spark, batch))
    for name, schema in (("catalogue", CATALOGUE), ("staging", STAGING), ("hierarchy", HIERARCHY)):
        assert _unstamped(store.get(spark, name), schema) == _unstamped(want._asdict()[name], schema)


def test_one_edit_changes_only_what_it_reaches(spark, tmp_path):
    rows = [{"id": i, "marketplace_sku": f"S{i}", "asin": f"A{i}", "im_sku": f"X{i % 500}"} for i in range(1, 2001)]
    old = catalogue(spark, rows)
    old.write.parquet(str(tmp_path / "catalogue"))
    edit = edits(spark, [{"id": 7, "marketplace_sku": "S7", "asin": "A7", "im_sku": "x7", "parent_sku": "P"}])
    stored = spark.read.parquet(str(tmp_path / "catalogue"))
    got = E.edit_changes(stored, staging(spark, []), edit)
    assert pick(got.catalogue, "id", "parent_sku") == [(1007, "P"), (1507, "P"), (507, "P"), (7, "P")]
    assert pick(got.staging, "id") == [(7,)]
    assert pick(got.hierarchy, "im_sku", "parent_sku") == [("x7", "P")]
    # Once more: the others hold the parent already.
    E.apply_edits(stored, staging(spark, []), hierarchy(spark, []), edit).catalogue.write.parquet(str(tmp_path / "after"))
    again = E.edit_changes(spark.read.parquet(str(tmp_path / "after")), staging(spark, []), edit)
    assert pick(again.catalogue, "id") == [(7,)]

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skuflow import adapter
from skuflow import schemas as S
from skuflow.functions import fold_case
from skuflow.operators import mapping as M
from skuflow.plans import jobs
from skuflow.session import shared_dir, stage, stage_scope
from skuflow.sources import tables as T
from tests.helpers import catalogue, frame, pick

HEADER = "SalesChannel,marketplace_sku,asin,im_sku,region,level_1,Linnworks Title,linnwork's_sku_received_from"


def test_csv_by_name_with_nulls_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        HEADER + ',Comment\nch,S1,A1,nan,DE,NA,"two\nlines, ""quoted""", scm ,\n,S2,A2,00123,IT,,T,None,hello\n'
    )
    rows = pick(T.read_catalogue_csv(spark, str(path)), *S.CSV_COLUMN_NAMES.values())
    assert rows == [
        ("S1", "A1", None, "DE", "ch", None, 'two\nlines, "quoted"', " scm ", None),
        ("S2", "A2", "00123", "IT", None, None, "T", None, "hello"),
    ]


def test_csv_comment_is_optional_but_others_are_not(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(HEADER + "\nch,S1,A1,I,DE,l,t,m\n")
    assert pick(T.read_catalogue_csv(spark, str(path)), "marketplace_sku", "comment") == [("S1", None)]
    path = tmp_path / "d.csv"
    path.write_text("marketplace_sku\nS\n")
    with pytest.raises(ValueError, match="asin"):
        T.read_catalogue_csv(spark, str(path))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(' a "b"', "x\ny"), (None, "é")], "p string, q string")
    T.write_csv(df, str(tmp_path / "out"))
    back = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        .csv(str(tmp_path / "out"))
    )
    assert pick(back, "p", "q") == pick(df, "p", "q")


def test_conform_defaults_fill_missing_columns_only(spark):
    df = spark.createDataFrame([("S", None)], "sku string, company string")
    out = T.conform(
        df, S.HIERARCHY, {"sku": "marketplace_sku"},
        {"company": S.DEFAULT_COMPANY, "channel": S.DEFAULT_CHANNEL},
    )
    assert out.columns == S.HIERARCHY.names
    assert pick(out, "marketplace_sku", "company", "channel", "asin") == [("S", None, "Amazon", None)]


def test_require_fields(spark):
    df = spark.createDataFrame([("a", "b"), (" ", "b"), ("a", None)], "x string, y string")
    ok, skipped = T.require_fields(df, ["x", "y"])
    assert pick(ok, "x") == [("a",)] and skipped.count() == 2


def test_json_keeps_nulls(spark):
    record = json.loads(T.dashboard_rows(catalogue(spark, [{"id": 1}])).first().record)
    assert list(record) == S.CATALOGUE.names
    assert record["im_sku"] is None and record["created_at"] == "2024-01-01T00:00:00Z"


def test_lookup_by_id(spark):
    df = catalogue(spark, [{"id": i} for i in range(4)])
    assert pick(T.lookup_by_id(df, [1, 3, 9]), "id") == [(1,), (3,)]
    assert pick(T.lookup_by_id(df, spark.range(2)), "id") == [(0,), (1,)]


def test_snapshots_are_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "tables")
    one, two = spark.range(1), spark.range(2)
    assert T.versions(spark, root) == []
    assert T.commit(spark, root, {"a": one, "b": one}, txn="t1") == 1
    bad = spark.range(1).selectExpr("raise_error('boom') as id")
    with pytest.raises(Exception, match="boom"):
        T.commit(spark, root, {"a": two, "b": bad}, txn="t2")
    assert T.versions(spark, root) == [1]
    assert T.read_table(spark, root, "a").count() == 1
    assert T.committed(spark, root, "t1") and not T.committed(spark, root, "t2")
    assert T.commit(spark, root, {"a": T.read_table(spark, root, "a").union(two), "b": two}) == 2
    assert T.read_table(spark, root, "a").count() == 3
    assert T.read_table(spark, root, "a", version=1).count() == 1
    assert T.commit(spark, root, {"b": one}) == 3
    assert T.read_table(spark, root, "a").count() == 3
    assert T.read_table(spark, root, "b").count() == 1
    with pytest.raises(LookupError):
        T.read_table(spark, root, "c")


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Context.master = "local[2]"
    assert shared_dir(Session) == shared_dir(Session)


def test_stage_tables_live_in_the_shared_folder(spark):
    with stage_scope(spark):
        staged = stage(spark.range(3), "probe")
        path = staged.inputFiles()[0]
        assert shared_dir(spark).removeprefix("file:") in path
        assert staged.count() == 3
    fs, target = T._fs(spark, path.rsplit("/", 1)[0])
    assert not fs.exists(target)


def _lines(path, rows):
    head = ",".join(S.CSV_COLUMN_NAMES)
    path.write_text("\n".join([head, *[",".join(r) for r in rows]]) + "\n")


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_positions_follow_the_files(spark, conf, tmp_path, multi_line):
    # Values fall as lines go on; files are cut into blocks where they may be.
    conf(spark__sql__files__maxPartitionBytes="2KB", spark__sql__files__openCostInBytes="1")
    for f in range(3):
        _lines(tmp_path / f"part-{f}.csv", [
            ["S", "A", f"IM{900 - 300 * f - i:04d}", "DE", "Amazon.de", "L", "T", "m", str(300 * f + i)] for i in range(300)
        ])
    rows = T.read_catalogue_csv(spark, str(tmp_path), multi_line, positions=True)
    assert multi_line or rows.rdd.getNumPartitions() > 3
    old = catalogue(spark, [{"id": 41}])
    done = jobs.dump(old, rows, frame(spark, S.FEED, []))
    got = done.catalogue.where("id > 41").select("id", "comment").collect()
    assert sorted((r.id, int(r.comment)) for r in got) == [(42 + i, i) for i in range(900)]
    last = M.last_by_sku_region(M.column_subset(M.mapped_only(done.catalogue))).first()
    assert last.rec.comment == "899" and last.rec.im_sku == "IM0001"


def test_csv_rejects_keep_their_position(spark, tmp_path):
    _lines(tmp_path / "a.csv", [["S", "A", "I", "DE", "", "", "", "", ""], ["", "A", "I", "DE", "", "", "", "", ""]])
    rows = T.read_catalogue_csv(spark, str(tmp_path / "a.csv"), positions=True)
    rejects = jobs.dump(catalogue(spark, []), rows, frame(spark, S.FEED, [])).rejects
    assert [(r._position.row, r.marketplace_sku) for r in rejects.collect()] == [(1, None)]


def test_feed_of_some_regions_opens_their_folders(spark, tmp_path):
    path = str(tmp_path / "feed")
    rows = [{"seller_sku": f"s{i}", "region": ["DE", "ES", "IT", None][i % 4], "title": "t"} for i in range(40)]
    T.write_feed(frame(spark, S.FEED, rows), path)
    assert pick(T.read_feed(spark, path), "region", "seller_sku") == pick(frame(spark, S.FEED, rows), "region", "seller_sku")
    # Repeated and unknown regions and a null choose nothing more.
    wanted = spark.createDataFrame([("DE",), ("DE",), ("XX",), (None,)], "region string").where("length(region) = 2")
    some = T.read_feed(spark, path, wanted)
    assert some.columns == S.FEED.names
    assert pick(some, "seller_sku") == sorted((f"s{i}",) for i in range(0, 40, 4))
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()
    assert T.read_feed(spark, path, wanted.limit(0)).count() == 0


def test_feed_export_keeps_nulls_and_quotes(spark, tmp_path):
    feed = frame(spark, S.FEED, [
        {"seller_sku": " s1", "asin": "A", "region": "DE", "sales_channel": "x", "order_status": "Shipped", "title": 'a "b", c'},
        {"seller_sku": "s2", "asin": "A", "region": "DE", "sales_channel": "x", "order_status": "Shipped", "title": None},
    ])
    jobs.export_feed(feed, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["SellerSKU", "ASIN", "Region", "SalesChannel", "Date", "Title"]
    assert pick(back, "SellerSKU", "Title") == [("S1", 'a "b", c'), ("S2", None)]


def test_catalogue_leaves_no_constant_to_fold_in_the_driver(spark, tmp_path):
    keys = [1, 5, 26, 31, 42, None]
    spark.createDataFrame(
        [(k, "name", "brand", "type", 1) for k in keys],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    ).write.parquet(f"{tmp_path}/part.parquet")
    folded = adapter.catalogue(spark, str(tmp_path)).select("id", fold_case(F.col("im_sku")).alias("low"))
    assert "lower(CASE" in folded._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["low"] for r in folded.collect()} == {
        1: "im0", 5: None, 26: "im1000004", 31: "", 42: "im1+", None: None,
    }

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skuflow.operators import edit_history as H
from skuflow.operators import edits as E
from skuflow.operators import ordered
from skuflow.operators.spans import least_holding
from skuflow.schemas import ATTRIBUTIONS, CATALOGUE, HIERARCHY, STAGING
from skuflow.session import stage_counted
from tests.helpers import NOW, OLD, catalogue, edits, hierarchy, pick, staging

SET = [
    "marketplace_sku", "asin", "im_sku", "region", "sales_channel", "level_1",
    "linworks_title", "comment", "comment_by_finance",
]


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _blank(v):
    return v is None or v.strip() == ""


def _single_edit(table, staged, held, edit):
    """One edit on lists of dicts, step by step."""
    table = {r["id"]: dict(r) for r in table}
    obj = table.setdefault(
        edit["id"], {**dict.fromkeys(CATALOGUE.names), "id": edit["id"], "created_at": NOW}
    )
    for c in SET:
        obj[c] = edit.get(c)
    parent = edit.get("parent_sku")
    parent = parent.strip() if parent else None
    obj["parent_sku"], obj["updated_at"] = parent, NOW
    for c in ATTRIBUTIONS:
        if not _blank(edit.get(c)):
            obj[c] = edit[c]
    department = next((c for c in ATTRIBUTIONS if not _blank(edit.get(c))), None)
    key = (edit.get("im_sku") or "").strip()
    same = [r for r in table.values() if r["im_sku"] is not None and r["im_sku"].lower() == key.lower()]
    own = dict(obj)
    held = [dict(h) for h in held]
    if key:
        for r in same:
            r["parent_sku"] = parent
            if department:
                r[department] = edit[department]
        for h in held:
            if h["im_sku"] == key:
                h["parent_sku"] = parent
        for r in sorted(same, key=lambda r: r["id"]):
            if r["id"] != edit["id"] and not _blank(r["level_1"]) and not _blank(r["linworks_title"]):
                for c in ("level_1", "linworks_title"):
                    if _blank(obj[c]):
                        obj[c] = own[c] = r[c]
                break
    count = 0
    for r in table.values():
        if r["asin"] == edit["asin"]:
            count += 1
            r["im_sku"] = edit.get("im_sku")
            if department:
                r[department] = edit[department]
    staged = {r["id"]: dict(r) for r in staged}
    row = staged.setdefault(
        edit["id"], {**dict.fromkeys(STAGING.names), "id": edit["id"], "created_at": NOW}
    )
    for c in [*ATTRIBUTIONS, "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "level_1", "linworks_title"]:
        row[c] = own[c]
    channel = edit["sales_channel"]
    row["marketplace"] = "Amazon.uk" if channel == "Amazon.co.uk" else channel
    row["company"] = {"ES": "B2fitness LTD"}.get(edit["region"], "B2fitness")
    row["marketplace_sales_table"], row["channel"] = "stg_tr_amazon_raw", "Amazon"
    row["updated_at"] = NOW
    many = " skus have been updated for ASIN ({}). Refresh your screen to see the changes."
    one = " sku has been updated for ASIN ({})."
    message = f"{count} ({key})" + (many if count > 1 else one).format(edit["asin"])
    return list(table.values()), list(staged.values()), held, (count, message)


def _random_tables(rng):
    name = lambda *more: rng.choice([None, "", " ", *more])
    table = [
        {
            **dict.fromkeys(CATALOGUE.names), "id": i, "marketplace_sku": f"S{i}",
            "asin": rng.choice("AB"), "region": "DE", "im_sku": rng.choice([None, "", "x1", "X1", " x1", "X2"]),
            "level_1": name("L1", "L2"), "linworks_title": name("T1", "T2"), "parent_sku": name("P"),
            "modified_by": rng.choice([None, "m"]), "comment": name("c"), "amazon_title": "t",
            "created_at": OLD, "updated_at": OLD,
        }
        for i in range(1, 8)
    ]
    staged = [
        {**dict.fromkeys(STAGING.names), "id": 2, "marketplace_sku": "S2", "asin": "A", "region": "DE",
         "marketplace": "m", "level_3": "kept", "comment": "kept", "marketplace_sales_table": "t",
         "channel": "c", "company": "x", "created_at": OLD, "updated_at": OLD},
    ]
    held = [{**dict.fromkeys(HIERARCHY.names), "marketplace_sku": f"H{i}", "im_sku": v} for i, v in enumerate(["x1", "X1", None])]
    number = rng.randrange(1, 10)
    edit = {
        "edit_seq": 1, "id": number, "marketplace_sku": f"S{number}", "asin": rng.choice("ABC"),
        "region": rng.choice(["DE", "ES", "UK"]), "sales_channel": rng.choice(["Amazon.co.uk", "Amazon.de"]),
        "im_sku": rng.choice([None, "", "  ", "x1", " X1 ", "X2", "new"]), "parent_sku": name(" P9 "),
        "level_1": name("LE"), "linworks_title": name("TE"), "comment": name("ce"),
        **{c: name("someone") for c in ATTRIBUTIONS},
    }
    return table, staged, held, edit


def _mark(case, row, columns):
    for c in columns:
        if not _blank(row.get(c)):
            value = row[c]
            at = len(value) - len(value.lstrip())
            row[c] = f"{value[:at]}{case}:{value[at:]}"


@pytest.mark.parametrize("seed", range(3))
def test_single_edits_equal_step_by_step(spark, seed):
    """Many cases of one edit each; a case number in every key keeps them apart."""
    rng = random.Random(seed)
    given, want = ([], [], []), ([], [], [])
    batch, lines = [], []
    for case in range(50):
        *tables, edit = _random_tables(rng)
        edit["edit_seq"] = case
        for row in [*tables[0], *tables[1], *tables[2], edit]:
            _mark(case, row, ["marketplace_sku", "asin", "im_sku"])
            if "id" in row:
                row["id"] += 100 * case
        *after, line = _single_edit(*tables, edit)
        batch.append(edit)
        lines.append((case, *line))
        for rows, new in zip(given + want, [*tables, *after]):
            rows += new
    got = E.apply_edits(
        catalogue(spark, given[0]), staging(spark, given[1]), hierarchy(spark, given[2]),
        edits(spark, batch), _now(),
    )
    for df, rows, schema in zip(got, want, (CATALOGUE, STAGING, HIERARCHY)):
        expected = sorted(
            (tuple(r[n] for n in schema.names) for r in rows),
            key=lambda r: [(v is not None, str(v)) for v in r],
        )
        assert pick(df, *schema.names) == expected
    assert sorted(pick(got.summary, "edit_seq", "updated_count", "message")) == lines
    assert got.rejects.count() == 0


def _in_order(table, staged, held, batch):
    """Edits one after another; also the reason of those that are rejected."""
    lines, reasons = [], {}
    for edit in sorted(batch, key=lambda e: e["edit_seq"]):
        if any(r["marketplace_sku"] == edit["marketplace_sku"] and r["id"] != edit["id"] for r in staged):
            reasons[edit["edit_seq"]] = "duplicate_sku"
            continue
        table, staged, held, line = _single_edit(table, staged, held, edit)
        lines.append((edit["edit_seq"], *line))
    return table, staged, held, lines, reasons


def _random_batch(rng, ids, n):
    name = lambda *more: rng.choice([None, "", " ", *more])
    keys = ["x1", "X1", " x1", "x2", "x3", "X3 "]
    table = [
        {
            **dict.fromkeys(CATALOGUE.names), "id": i, "marketplace_sku": f"S{i}", "asin": rng.choice("ABC"),
            "region": "DE", "im_sku": rng.choice([None, "", *keys]), "level_1": name(f"L{i}", f"M{i}"),
            "linworks_title": name(f"T{i}", f"U{i}"), "parent_sku": name(f"P{i}"),
            "modified_by": rng.choice([None, f"m{i}"]), "comment": name("c"), "amazon_title": "t",
            "created_at": OLD, "updated_at": OLD,
        }
        for i in ids if rng.random() < 0.7
    ]
    skus = rng.sample(ids, 3)
    staged = [
        {**dict.fromkeys(STAGING.names), "id": i, "marketplace_sku": f"S{i}", "asin": "A", "region": "DE",
         "marketplace": "m", "level_3": "kept", "comment": "kept", "marketplace_sales_table": "t",
         "channel": "c", "company": "x", "created_at": OLD, "updated_at": OLD}
        for i in skus
    ]
    held = [{**dict.fromkeys(HIERARCHY.names), "marketplace_sku": f"H{i}", "im_sku": v} for i, v in enumerate(["x1", "X1", "x2", None])]
    batch = []
    for seq in range(n):
        number = rng.choice(ids)
        other = rng.choice(ids) if rng.random() < 0.3 else number
        batch.append({
            "edit_seq": 10 * seq + 3, "id": number, "marketplace_sku": f"S{other}", "asin": rng.choice("ABCD"),
            "region": rng.choice(["DE", "ES", "UK"]), "sales_channel": rng.choice(["Amazon.co.uk", "Amazon.de"]),
            "im_sku": rng.choice([None, "", "  ", *keys, "new"]), "parent_sku": name(f" Q{seq} "),
            "level_1": name(f"LE{seq}"), "linworks_title": name(f"TE{seq}"), "comment": name("ce"),
            **{c: name(f"{c[-3:]}{seq}") if rng.random() < 0.6 else None for c in ATTRIBUTIONS},
        })
    return table, staged, held, batch


def _same(df, rows, schema):
    expected = sorted(
        (tuple(r[n] for n in schema.names) for r in rows),
        key=lambda r: [(v is not None, str(v)) for v in r],
    )
    assert pick(df, *schema.names) == expected


@pytest.mark.parametrize("seed, few", [(0, H.FEW), (1, H.FEW), (2, 0)])
def test_batches_equal_edits_in_order(spark, monkeypatch, seed, few):
    """Many groups of edits that meet in ids, ASINs, internal SKUs and SKUs."""
    monkeypatch.setattr(H, "FEW", few)
    rng = random.Random(100 + seed)
    given, want, lines, reasons, batch = ([], [], []), ([], [], []), [], {}, []
    for case in range(40):
        table, staged, held, edits_of = _random_batch(rng, list(range(1, 7)), rng.randint(2, 30))
        for edit in edits_of:
            edit["edit_seq"] += 1000 * case
        for row in [*table, *staged, *held, *edits_of]:
            _mark(case, row, ["marketplace_sku", "asin", "im_sku"])
            if "id" in row:
                row["id"] += 100 * case
        *after, said, why = _in_order(table, staged, held, edits_of)
        batch += edits_of
        lines += said
        reasons |= why
        for rows, new in zip(given + want, [table, staged, held, *after]):
            rows += new
    assert len(reasons) > 20
    rng.shuffle(batch)
    got = E.apply_edits(
        catalogue(spark, given[0]), staging(spark, given[1]), hierarchy(spark, given[2]),
        edits(spark, batch), _now(),
    )
    assert {r.edit_seq: r.reason for r in got.rejects.collect()} == reasons
    assert sorted(pick(got.summary, "edit_seq", "updated_count", "message")) == sorted(lines)
    _same(got.hierarchy, want[2], HIERARCHY)
    _same(got.staging, want[1], STAGING)
    _same(got.catalogue, want[0], CATALOGUE)


def test_batch_last_edit_wins_per_key(spark):
    cat = catalogue(spark, [
        {"id": 1, "marketplace_sku": "S1", "im_sku": "X"}, {"id": 2, "marketplace_sku": "S2", "im_sku": "x"},
        {"id": 3, "marketplace_sku": "S3", "asin": "B", "im_sku": "other"},
    ])
    batch = edits(spark, [
        {"edit_seq": 1, "id": 1, "marketplace_sku": "S1", "im_sku": "X", "parent_sku": "first", "modified_by": "scm"},
        {"edit_seq": 2, "id": 1, "marketplace_sku": "S1", "im_sku": "X", "parent_sku": "second", "modified_by_finance": "fin"},
        {"edit_seq": 3, "id": 3, "marketplace_sku": "S3", "asin": "B", "im_sku": "Y", "parent_sku": ""},
    ])
    got = E.apply_edits(cat, staging(spark, []), hierarchy(spark, []), batch, _now())
    assert pick(got.catalogue, "id", "im_sku", "parent_sku", "modified_by", "modified_by_finance") == [
        (1, "X", "second", "scm", "fin"), (2, "X", "second", "scm", "fin"), (3, "Y", None, None, None),
    ]
    assert pick(got.staging, "id", "parent_sku") == [(1, "second"), (3, None)]
    answers = E.edit_responses(got.catalogue, got.objects, got.summary)
    assert pick(answers, "id", "im_sku", "created", "message") == [
        (1, "X", False, "2 (X) skus have been updated for ASIN (A). Refresh your screen to see the changes."),
        (3, "Y", False, "1 (Y) sku has been updated for ASIN (B)."),
    ]


def test_rows_gaining_an_im_sku_keep_their_parent(spark):
    cat = catalogue(spark, [
        {"id": 1, "marketplace_sku": "S1", "im_sku": "X"},
        {"id": 2, "marketplace_sku": "S2", "im_sku": "Z", "parent_sku": "own"},
    ])
    batch = edits(spark, [{"id": 1, "marketplace_sku": "S1", "im_sku": "X", "parent_sku": "P"}])
    got = E.apply_edits(cat, staging(spark, []), hierarchy(spark, []), batch, _now())
    assert pick(got.catalogue, "id", "im_sku", "parent_sku") == [(1, "X", "P"), (2, "X", "own")]


def test_rejects(spark):
    before = staging(spark, [{"id": 50, "marketplace_sku": "TAKEN"}, {"id": 5, "marketplace_sku": "MINE"}])
    batch = edits(spark, [
        {"edit_seq": 1, "id": 1, "region": "FR"}, {"edit_seq": 2, "id": 1, "asin": None},
        {"edit_seq": 3, "id": 1, "marketplace_sku": None}, {"edit_seq": 4, "id": 1, "sales_channel": None},
        {"edit_seq": 5, "id": 1, "region": None}, {"edit_seq": 6, "id": None},
        {"edit_seq": 7, "id": 1, "marketplace_sku": "TAKEN"}, {"edit_seq": 8, "id": 5, "marketplace_sku": "MINE"},
        {"edit_seq": 9, "id": 1, "marketplace_sku": "NEW"}, {"edit_seq": 10, "id": 2, "marketplace_sku": "NEW"},
        {"edit_seq": 11, "id": 1, "marketplace_sku": "NEW"}, {"edit_seq": 12, "id": 3, "marketplace_sku": "", "asin": ""},
    ])
    got = {r.edit_seq: r.reason for r in H.check_edits(batch, before).collect()}
    assert got == {
        1: "no_company", 2: "missing_asin", 3: "missing_marketplace_sku", 4: "missing_sales_channel",
        5: "missing_region", 6: "missing_id", 7: "duplicate_sku", 8: None, 9: None,
        10: "duplicate_sku", 11: None, 12: None,
    }


def test_sides_as_large_as_a_batch_are_not_broadcast(spark):
    # The driver builds each broadcast, and a batch of edits takes dozens of joins.
    spans = spark.createDataFrame([("k", 1, 5, 7), ("k", 2, 3, 8)], "key string, lo long, hi long, id long")
    points = spark.createDataFrame([("k", 2, 1), ("k", 9, 2)], "key string, at long, point long")
    got = least_holding(spans, points, 4)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 7, 8)]


def test_a_round_of_sku_claims_sorts_its_rows_once(spark):
    # Two ways of counting share the windows: the driver plans and compiles half as much.
    rows = spark.createDataFrame(
        [(1, "S", 0, 1), (2, "S", 1, 0), (1, "T", 2, 1), (2, "S", 3, 0), (3, "S", 4, 0), (3, "U", 5, 0)],
        "id long, marketplace_sku string, pos long, state int",
    )
    got = H._round(rows, 4)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3
    assert pick(got, "pos", "state") == [(0, 1), (1, -1), (2, 1), (3, 1), (4, 0), (5, 1)]


def test_totals_of_few_rows_are_not_staged(spark, monkeypatch):
    rng = random.Random(5)
    rows = spark.createDataFrame(
        [(rng.choice("ABC"), at, rng.choice([-1, 0, 1])) for at in range(60)], "asin string, at long, change int"
    )
    sliced = pick(ordered.running_total(rows, "asin", "at", "change", "moved", "totals"), "asin", "at", "moved")
    monkeypatch.setattr(ordered, "stage", None)
    bounded = ordered.running_total(rows, "asin", "at", "change", "moved", "totals", bounded=True)
    assert pick(bounded, "asin", "at", "moved") == sliced
    assert bounded.columns == ["asin", "at", "change", "moved"]


def test_totals_of_a_stage_are_added_up_by_its_write(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n long, s string")
    spark.sparkContext.setJobGroup("counted", "")
    staged, seen = stage_counted(rows, "counted", n=F.count("*"), s=F.count("s"), last=F.max("n"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    assert seen == {"n": 3, "s": 2, "last": 3} and len(jobs) == 1
    assert pick(staged, "n", "s") == [(1, "a"), (2, None), (3, "b")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # A side that turns out to be empty while the write runs has totals too.
    none = rows.join(rows.where("n > 5").groupBy("s").count(), "s")
    assert stage_counted(none, "counted", n=F.count("*"), last=F.max("n"))[1] == {"n": 0, "last": None}


def _shared(spark):
    """Rows 3 to 6 share the internal SKU of edits until their ASIN, if any, gets another; id 9
    is there twice."""
    cat = catalogue(spark, [
        {"id": 1, "asin": "A", "im_sku": "X"}, {"id": 2, "asin": "B", "im_sku": "X"},
        {"id": 3, "asin": "C", "im_sku": "x"}, {"id": 4, "asin": "A", "im_sku": "X"},
        {"id": 5, "asin": "B", "im_sku": "X"}, {"id": 6, "asin": "B", "im_sku": "X"},
        {"id": 9, "asin": "D", "im_sku": "X"}, {"id": 9, "asin": "D", "im_sku": "X"},
    ])
    batch = edits(spark, [
        {"edit_seq": 1, "id": 7, "marketplace_sku": "S7", "asin": "Z", "im_sku": "X", "parent_sku": "P1"},
        {"edit_seq": 2, "id": 1, "marketplace_sku": "S1", "asin": "A", "im_sku": "Y", "parent_sku": "P2"},
        {"edit_seq": 3, "id": 7, "marketplace_sku": "S7", "asin": "Z", "im_sku": "X", "parent_sku": "P3"},
        {"edit_seq": 4, "id": 2, "marketplace_sku": "S2", "asin": "B", "im_sku": "W", "parent_sku": "P4"},
        {"edit_seq": 5, "id": 7, "marketplace_sku": "S7", "asin": "Z", "im_sku": "X", "parent_sku": "P5"},
    ])
    return cat, batch


def test_other_rows_are_neither_ranged_nor_staged_for_few_edits(spark, monkeypatch):
    cat, batch = _shared(spark)
    want = E.apply_edits(cat, staging(spark, []), hierarchy(spark, []), batch, _now())
    rows = pick(want.catalogue, "id", "im_sku", "parent_sku")
    assert [r for r in rows if r[0] in (3, 4, 5, 6)] == [
        (3, "x", "P5"), (4, "Y", "P1"), (5, "W", "P3"), (6, "W", "P3"),
    ]
    monkeypatch.setattr(H, "FEW", 0)
    many = E.apply_edits(cat, staging(spark, []), hierarchy(spark, []), batch, _now())
    assert pick(many.catalogue, "id", "im_sku", "parent_sku") == rows
    monkeypatch.setattr(H, "FEW", 1_000_000)
    b = E._batch(cat, staging(spark, []), batch, _now())
    monkeypatch.setattr(ordered, "stage", None)
    got = E._other_rows(cat, b.objects, b.history, b.ends, True)
    assert pick(got, "id", "im_sku", "parent_sku") == [r for r in rows if r[0] not in (1, 2, 7)]


def test_answers_take_the_edited_rows_only(spark):
    cat, batch = _shared(spark)
    got = E.apply_edits(cat, staging(spark, []), hierarchy(spark, []), batch, _now())
    assert pick(got.answered, *CATALOGUE.names) == pick(got.catalogue.where("id in (1, 2, 7)"), *CATALOGUE.names)
    whole = E.edit_responses(got.catalogue, got.objects, got.summary)
    answers = E.edit_responses(got.answered, got.objects, got.summary)
    assert pick(answers, *answers.columns) == pick(whole, *whole.columns) and answers.count() == 3

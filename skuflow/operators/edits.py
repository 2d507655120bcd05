"""Apply batches of human edits and propagate them through the tables.

``apply_edits`` gives what the edits give one after another (``edit_history``). The steps a
single edit takes are operators of their own as well: ``upsert_by_id``, ``propagate_parent``
and the others set or spread the last edit of each id, internal SKU or ASIN.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions import (
    canonical_channel, company_for_region, department_of, edit_strip, fold_case,
    is_blank, strip, utc_now,
)
from skuflow.functions.text import department_column
from skuflow.operators import edit_history as H
from skuflow.operators.joins import keep_matching, lookup, put
from skuflow.operators.mapping import fill_blank
from skuflow.operators.ordered import last_before
from skuflow.schemas import (
    ATTRIBUTIONS, CATALOGUE, DEFAULT_CHANNEL, DEFAULT_SALES_TABLE, EDITS, STAGING,
)
from skuflow.session import stage, stage_counted

_SET_BY_EDIT = [
    "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "sales_channel",
    "level_1", "linworks_title", "comment", "comment_by_finance",
]
_DEPARTMENT_NAMES = ["SCM", "FINANCE", "ADMIN"]


def _im_key() -> Column:
    """Key an edit's internal SKU is matched by; null when blank."""
    value = strip(F.col("im_sku"))
    return F.when(value != "", fold_case(value))


def _last(value: Column, when: Column | None = None) -> Column:
    order = F.col("edit_seq")
    return F.max_by(value, order if when is None else F.when(when, order))


def last_edit_per_id(valid: DataFrame) -> DataFrame:
    """Per id: the last edit's values and the last non-blank attributions (M1, M2)."""
    values = [
        edit_strip(F.col(c)).alias(c) if c == "parent_sku" else F.col(c)
        for c in _SET_BY_EDIT
    ]
    names = [_last(F.col(c), ~is_blank(F.col(c))).alias(c) for c in ATTRIBUTIONS]
    return valid.groupBy("id").agg(
        _last(F.struct(*values)).alias("edit"), F.max("edit_seq").alias("edit_seq"), *names
    ).select("id", "edit_seq", "edit.*", *ATTRIBUTIONS)


def edited_objects(catalogue: DataFrame, valid: DataFrame, now: Column) -> DataFrame:
    """The edited catalogue rows, known or new (M1, M2).

    Columns an edit does not carry keep their value; new rows get null.
    """
    last = last_edit_per_id(valid)
    kept = [c for c in CATALOGUE.names if c not in {*_SET_BY_EDIT, "id", "updated_at"}]
    old = catalogue.join(last.select("id"), "id", "left_semi").select(
        "id", F.struct(*kept).alias("old")
    )
    joined = lookup(last, old, {"id": F.col("id")}, "old", hot=False)
    columns = []
    for f in CATALOGUE:
        c = f.name
        if c in _SET_BY_EDIT or c == "id":
            value = F.col(c)
        elif c in ATTRIBUTIONS:
            value = F.coalesce(F.col(c), F.col(f"old.{c}"))
        elif c == "updated_at":
            value = now
        elif c == "created_at":
            value = F.coalesce(F.col(f"old.{c}"), now)
        else:
            value = F.col(f"old.{c}")
        columns.append(value.cast(f.dataType).alias(c))
    return joined.select(*columns, "edit_seq", F.col("old").isNull().alias("created"))


def untouched(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def upsert_by_id(catalogue: DataFrame, objects: DataFrame) -> DataFrame:
    """Catalogue with the edited rows in place of their old versions (M1).

    Anti join and union rather than a full outer join, which could not be broadcast: a
    small batch then never shuffles the catalogue.
    """
    return untouched(catalogue, objects).unionByName(objects.select(*CATALOGUE.names))


def _by_key(valid: DataFrame, key: Column, value: str, out: Column) -> DataFrame:
    """Per spread key: last value, and last attribution of each department."""
    marked = valid.withColumns({"dept": department_of(), "key": key})
    names = [
        _last(F.col(department_column(d)), F.col("dept") == d).alias(department_column(d))
        for d in _DEPARTMENT_NAMES
    ]
    return (
        marked.where(F.col("key").isNotNull()).groupBy("key")
        .agg(_last(F.struct(out.alias(value))).alias("last"), *names)
        .select("key", F.struct(f"last.{value}", *ATTRIBUTIONS).alias("rec"))
    )


def edits_by_im_sku(valid: DataFrame) -> DataFrame:
    return _by_key(valid, _im_key(), "parent_sku", edit_strip(F.col("parent_sku")))


def _edits_by_exact_im_sku(valid: DataFrame) -> DataFrame:
    value = strip(F.col("im_sku"))
    return _by_key(
        valid, F.when(value != "", value), "parent_sku", edit_strip(F.col("parent_sku"))
    )


def edits_by_asin(valid: DataFrame) -> DataFrame:
    return _by_key(valid, F.col("asin"), "im_sku", F.col("im_sku"))


def _spread(
    table: DataFrame, keyed: DataFrame, key: Column, value: str | None, named: bool
) -> DataFrame:
    joined = lookup(table, keyed, {"key": key})
    values = {value: F.col(f"rec.{value}")} if value else {}
    out = put(joined, F.col("rec").isNotNull(), values) if values else joined
    if named:
        out = out.withColumns({
            c: F.coalesce(F.col(f"rec.{c}"), F.col(c)) for c in ATTRIBUTIONS
        })
    return out.drop("rec")


def propagate_parent(table: DataFrame, valid: DataFrame, exact: bool = False) -> DataFrame:
    """Rows of an edited internal SKU take the edit's parent, null included (M3).

    ``exact`` compares as is instead of ignoring case: the hierarchy's rule (M4).
    """
    if not exact:
        keyed = edits_by_im_sku(valid)
        return _spread(table, keyed, fold_case(F.col("im_sku")), "parent_sku", False)
    return _spread(table, _edits_by_exact_im_sku(valid), F.col("im_sku"), "parent_sku", False)


def propagate_attribution_by_im_sku(catalogue: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows of an edited internal SKU take the editing department's name (M5)."""
    keyed = edits_by_im_sku(valid)
    return _spread(catalogue, keyed, fold_case(F.col("im_sku")), None, True)


def propagate_by_im_sku(catalogue: DataFrame, valid: DataFrame) -> DataFrame:
    """M3 and M5 in one join."""
    keyed = edits_by_im_sku(valid)
    return _spread(catalogue, keyed, fold_case(F.col("im_sku")), "parent_sku", True)


def propagate_im_sku_by_asin(catalogue: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows of an edited ASIN take its internal SKU and department name (M7)."""
    return _spread(catalogue, edits_by_asin(valid), F.col("asin"), "im_sku", True)


def first_reference(catalogue: DataFrame, objects: DataFrame) -> DataFrame:
    """Per edited internal SKU the complete catalogue row with the lowest id."""
    complete = ~is_blank(F.col("level_1")) & ~is_blank(F.col("linworks_title"))
    wanted = objects.select(_im_key().alias("key")).where("key is not null").distinct()
    candidates = catalogue.where(complete).select(
        fold_case(F.col("im_sku")).alias("im_key"), "id", "level_1", "linworks_title"
    )
    return (
        keep_matching(candidates, wanted, {"key": F.col("im_key")})
        .groupBy(F.col("im_key").alias("key"))
        .agg(F.min_by(F.struct("id", "level_1", "linworks_title"), F.col("id")).alias("ref"))
    )


def fill_from_reference(objects: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fill an edited row's blank category and title from another row (M6, P10).

    The lowest id per internal SKU is enough: an edited row with something to fill is
    incomplete, so it is never its own reference.
    """
    joined = lookup(objects, first_reference(catalogue, objects), {"key": _im_key()}, "ref")
    other = joined.withColumn("ref", F.when(F.col("ref.id") != F.col("id"), F.col("ref")))
    return fill_blank(other, "ref", ["level_1", "linworks_title"]).drop("ref")


def stage_edits(staging: DataFrame, objects: DataFrame, now: Column) -> DataFrame:
    """Staging with the edited rows set for publishing."""
    return untouched(staging, objects).unionByName(staged_rows(staging, objects, now))


def staged_rows(staging: DataFrame, objects: DataFrame, now: Column) -> DataFrame:
    """The edited rows as they are staged for publishing."""
    values = {
        "marketplace": canonical_channel(F.col("sales_channel")),
        "company": company_for_region(F.col("region")),
        "marketplace_sales_table": F.lit(DEFAULT_SALES_TABLE),
        "channel": F.lit(DEFAULT_CHANNEL),
        "updated_at": now,
    }
    same = [
        "marketplace_sku", "asin", "im_sku", "parent_sku", "region", "level_1",
        "linworks_title", *ATTRIBUTIONS,
    ]
    kept = [c for c in STAGING.names if c not in {*same, *values, "id"}]
    old = staging.join(objects.select("id"), "id", "left_semi").select(
        "id", F.struct(*kept).alias("old")
    )
    joined = lookup(
        objects.select("id", "sales_channel", *same), old, {"id": F.col("id")}, "old",
        hot=False, apart=True,
    )
    columns = []
    for f in STAGING:
        c = f.name
        if c == "id" or c in same:
            value = F.col(c)
        elif c in values:
            value = values[c]
        elif c == "created_at":
            value = F.coalesce(F.col("old.created_at"), now)
        else:
            value = F.col(f"old.{c}")
        columns.append(value.cast(f.dataType).alias(c))
    return joined.select(*columns)


def edit_responses(
    catalogue: DataFrame, objects: DataFrame, summary: DataFrame
) -> DataFrame:
    """What each edited id's last edit is answered with: its row as it is now, whether it
    was created, and the message (S4).

    ``catalogue`` is the stored new version, so that it is not computed again, or only its
    edited rows (``Edited.answered``): no other row has an answer.
    """
    said = objects.select("id", "edit_seq", "created").join(
        summary.select("edit_seq", "message").hint("merge"), "edit_seq"
    )
    return catalogue.join(said.drop("edit_seq"), "id").select(
        "id", *_SET_BY_EDIT, *ATTRIBUTIONS, "created", "message"
    )


class Edited(NamedTuple):
    catalogue: DataFrame
    staging: DataFrame
    hierarchy: DataFrame
    summary: DataFrame
    rejects: DataFrame
    objects: DataFrame  # the edited rows right after their own last edit
    answered: DataFrame  # the edited rows after all edits, as in ``catalogue``


def _objects_of(history: DataFrame, catalogue: DataFrame, fills: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Per edited id its row after its own last edit, with references' values and with the
    names that earlier edits have spread to it."""
    last = history.where(F.col("own_next") == H.END)
    own = {"id": F.col("id")}
    kept = ["date", "amazon_title", "created_at"]
    old = keep_matching(catalogue.select("id", *kept), last.select("id"), own, hot=False)
    joined = lookup(last, fills.select("pos", F.struct("level_1", "linworks_title").alias("filled")),
                    {"pos": F.col("pos")}, "filled", hot=False, apart=True)
    joined = lookup(joined, names.withColumnRenamed("rec", "names"), own, "names", hot=False, apart=True)
    joined = lookup(joined, old.select("id", F.struct(*kept).alias("old")), own, "old", hot=False, apart=True)
    values = {c: F.col(f"names.{c}") for c in ATTRIBUTIONS} | {
        "level_1": F.col("filled.level_1"), "linworks_title": F.col("filled.linworks_title"),
        "parent_sku": F.col("parent"), "date": F.col("old.date"), "amazon_title": F.col("old.amazon_title"),
        "created_at": F.coalesce("old.created_at", now), "updated_at": now,
    }
    columns = [values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CATALOGUE]
    return joined.select(*columns, "edit_seq", "pos", F.col("old").isNull().alias("created"))


def _spread_to(rows: DataFrame, pos: Column) -> DataFrame:
    """Rows with ``rec``, what their ASIN's edits have handed out, and ``lone``, what their
    internal SKU's edits had before; what is later than ``pos`` takes place."""
    def newest(c: str) -> Column:
        ended, alone = F.col(f"rec.{c}"), F.col(f"lone.{c}")
        return F.coalesce(F.when(ended["pos"] > pos, ended), alone)

    given, parent = F.col("rec.given"), newest("f_parent")
    out = put(rows, given.isNotNull(), {"im_sku": given["im_sku"]})
    out = put(out, parent.isNotNull(), {"parent_sku": parent["parent"]})
    return out.withColumns({
        a: F.coalesce(newest(c)["name"], F.col(a)) for a, c in H.FOUND.items()
    })


def _edited_rows(objects: DataFrame, history: DataFrame, ends: DataFrame) -> DataFrame:
    """Edited rows after all edits: what is later than their own last one reaches them."""
    lone = H.spreads(history).select(F.struct(*H.TAKEN).alias("lone")).schema["lone"].dataType
    edited = lookup(objects, ends, {"asin": F.col("asin")}, apart=True).withColumn("lone", F.lit(None).cast(lone))
    return _spread_to(edited, F.col("pos")).select(*CATALOGUE.names)


def _other_rows(
    catalogue: DataFrame, objects: DataFrame, history: DataFrame, ends: DataFrame, few: bool, changes: bool = False,
) -> DataFrame:
    """Rows without an edit of their own, as the edits of their ASIN and internal SKU leave them.

    The catalogue meets only what is as large as the batch: ids, ASINs and internal SKUs.
    With ``changes``, rows that stay as they are are left out.
    """
    by_asin = {"asin": F.col("asin")}
    others = untouched(catalogue, objects)
    spread = H.spreads(history)
    keys = spread.select("key").distinct()
    holding = keep_matching(
        others.select("id", "asin", fold_case(F.col("im_sku")).alias("key")), keys, {"key": F.col("key")}
    )
    holding = lookup(holding, ends, by_asin)
    asked = holding.select("key", F.coalesce("rec.first", F.lit(H.END)).alias("at"), "id")
    # Rows of an ASIN ask alike, so a key has no more times to ask for than the batch has ASINs.
    times = asked.select("key", "at").distinct()
    found = last_before(spread, times, "key", "at", H.TAKEN, "lone-rows", bounded=few)
    lone = lookup(
        asked, found.select("key", "at", F.struct(*H.TAKEN).alias("lone")),
        {"key": F.col("key"), "at": F.col("at")}, "lone",
    )
    others = lookup(others, ends, by_asin)
    others = lookup(others, lone.select("id", "lone"), {"id": F.col("id")}, "lone", hot=False)
    spread = F.struct("im_sku", "parent_sku", *ATTRIBUTIONS)
    others = _spread_to(others.withColumn("_was", spread), F.lit(0))
    if changes:
        others = others.where(~spread.eqNullSafe(F.col("_was")))
    return others.select(*CATALOGUE.names)


class _Batch(NamedTuple):
    checked: DataFrame
    valid: DataFrame
    history: DataFrame
    ends: DataFrame
    objects: DataFrame
    few: bool


def _batch(catalogue: DataFrame, staging: DataFrame, edits: DataFrame, now: Column) -> _Batch:
    """What the edits do, staged: all of it is as large as the batch."""
    is_valid = F.col("reason").isNull()
    checked, seen = stage_counted(
        H.check_edits(edits, staging), "checked-edits",
        valid=F.count_if(is_valid), last=F.max(F.when(is_valid, F.col("pos"))),
    )
    valid = checked.where(is_valid).select(*EDITS.names, "pos")
    few = seen["valid"] <= H.FEW
    history = H.with_history(valid, catalogue, few)
    events = stage(H.asin_events(history, H.handed_on(history, few)), "asin-events")
    ends = stage(H.at_the_end(events), "asin-ends")
    fills = stage(H.filled(history, catalogue, ends, H.block_levels(seen["last"]), few), "fills")
    names = stage(H.names_before_the_end(history, catalogue, events, ends, few), "edited-names")
    objects = stage(_objects_of(history, catalogue, fills, names, now), "edited")
    return _Batch(checked, valid, history, ends, objects, few)


def apply_edits(
    catalogue: DataFrame, staging: DataFrame, hierarchy: DataFrame, edits: DataFrame,
    now: Column | None = None,
) -> Edited:
    """New versions of the three tables, a line per edit, rejects, and the edited rows.

    The result is that of applying the edits one by one in the order of ``edit_seq``, so it
    does not depend on how a run of edits is cut into batches.
    """
    now = utc_now() if now is None else now
    b = _batch(catalogue, staging, edits, now)
    answered = _edited_rows(b.objects, b.history, b.ends)
    return Edited(
        catalogue=_other_rows(catalogue, b.objects, b.history, b.ends, b.few).unionByName(answered),
        staging=stage_edits(staging, b.objects, now),
        hierarchy=propagate_parent(hierarchy, b.valid, exact=True),
        summary=H.summary(b.history, catalogue, b.few),
        rejects=b.checked.where(F.col("reason").isNotNull()),
        objects=b.objects,
        answered=answered,
    )


class Changes(NamedTuple):
    """What a batch changes, for stores that can update rows in place."""
    catalogue: DataFrame  # whole rows, to be put in by id
    staging: DataFrame  # whole rows, to be put in by id
    hierarchy: DataFrame  # ``im_sku`` and the ``parent_sku`` that all rows with it take
    summary: DataFrame
    rejects: DataFrame


def edit_changes(
    catalogue: DataFrame, staging: DataFrame, edits: DataFrame, now: Column | None = None,
) -> Changes:
    """What ``apply_edits`` changes: edited rows, and others only where a value differs.

    The catalogue is read, but only rows that share an id, ASIN or internal SKU with the batch
    leave the scan; the hierarchy is not even read. All results are staged, so the tables may
    be written while these are read.
    """
    now = utc_now() if now is None else now
    b = _batch(catalogue, staging, edits, now)
    parents = _edits_by_exact_im_sku(b.valid).select(F.col("key").alias("im_sku"), "rec.parent_sku")
    parts = Changes(
        catalogue=_other_rows(catalogue, b.objects, b.history, b.ends, b.few, changes=True)
        .unionByName(_edited_rows(b.objects, b.history, b.ends)),
        staging=staged_rows(staging, b.objects, now),
        hierarchy=parents,
        summary=H.summary(b.history, catalogue, b.few),
        rejects=b.checked.where(F.col("reason").isNotNull()),
    )
    return Changes(*[stage(df, f"changed-{name}") for name, df in parts._asdict().items()])

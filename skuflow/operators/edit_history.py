"""What edits do one after another, computed for all of them at once.

An edit reads the tables as the edits before it left them. Yet each of its effects has a form
that needs no replay. Edits are numbered by ``edit_seq``; "before" means a lower number.

- A row's ASIN changes by its own edits only, so these cut its life into memberships.
- All rows of an ASIN take the internal SKU of each edit of that ASIN. Between two edits of
  an ASIN its rows therefore share one internal SKU, and the last edit of that internal SKU
  in between, found by an as-of join, is what the interval hands to them.
- Whoever holds a SKU in the staging table, and which row is another's reference, depends on
  earlier edits. Both are decided in rounds: a round settles all edits whose answer no
  undecided edit can change, and the first undecided edit is always among them. There is no
  limit on rounds; they are as many as the longest chain of edits that wait for each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions import company_for_region, department_of, edit_strip, fold_case, is_blank, strip
from skuflow.functions.text import department_column
from skuflow.operators.joins import keep_matching, lookup
from skuflow.operators.ordered import last_before, number_rows, running_total
from skuflow.operators.spans import held_by_others, least_holding, least_two
from skuflow.schemas import ATTRIBUTIONS, EDITS
from skuflow.session import stage, stage_counted

_REQUIRED = ["id", "marketplace_sku", "asin", "region", "sales_channel"]
_DEPARTMENTS = {"SCM": "d_scm", "FINANCE": "d_finance", "ADMIN": "d_admin"}
#: Column that holds what is found for each attribution.
FOUND = {department_column(d): c for d, c in _DEPARTMENTS.items()}
#: Later than any edit.
END = 1 << 62
#: Edits that are few enough for one task whatever they have in common.
FEW = 1_000_000


def block_levels(last: int | None) -> int:
    """Block sizes that cover all numbers of the edits, up to ``last``."""
    return int(last or 0).bit_length() + 1


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# Which edits are valid.


def check_edits(edits: DataFrame, staging: DataFrame) -> DataFrame:
    """Edits with ``pos``, their number from 1, and the ``reason`` to reject them, null for
    valid ones (D14).

    Rejected are edits the tables could not store: a missing required value, a region
    without a company, or a SKU that another id holds in the staging table at that moment. A
    valid edit takes its SKU for its id and gives up the one the id had.
    """
    reason = F.when(company_for_region(F.col("region")).isNull(), F.lit("no_company"))
    for c in reversed(_REQUIRED):
        reason = F.when(F.col(c).isNull(), F.lit(f"missing_{c}")).otherwise(reason)
    order = ["edit_seq", "id", "marketplace_sku", "asin"]
    # Staged, as is all that several steps read: otherwise the plan of each of them, which the
    # driver holds, repeats the steps before.
    numbered = stage(number_rows(
        edits.select(*EDITS.names, reason.alias("reason")), order, F.lit(0), "pos", "sliced-edits"
    ), "numbered-edits")
    wanted = numbered.where("reason is null").select("id", "marketplace_sku").distinct()
    skus = wanted.select("marketplace_sku").distinct()
    holders = keep_matching(
        staging.select("id", "marketplace_sku"), skus, {"marketplace_sku": F.col("marketplace_sku")}
    )
    claims = stage(wanted.unionByName(holders), "claims")
    # SKUs that more than one id wants or holds; all others are free to whoever wants them.
    contested = (
        claims.groupBy("marketplace_sku")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
        .select("marketplace_sku", F.lit(True).alias("contested"))
    )
    contested, seen = stage_counted(contested, "contested-skus", n=F.count("*"))
    if not seen["n"]:
        return numbered
    rejected = _rejected(numbered, staging, claims, contested)
    return lookup(
        numbered, rejected.select("pos", F.lit("duplicate_sku").alias("late")), {"pos": F.col("pos")},
        "late", hot=False, apart=True,
    ).withColumn("reason", F.coalesce("reason", "late")).drop("late")


def _rejected(numbered: DataFrame, staging: DataFrame, claims: DataFrame, contested: DataFrame) -> DataFrame:
    """``pos`` of the edits that find their SKU held by another id."""
    sku = {"marketplace_sku": F.col("marketplace_sku")}
    ids = keep_matching(claims, contested.select("marketplace_sku"), sku, apart=True).select("id").distinct()
    own = {"id": F.col("id")}
    # What the ids hold at first counts as edits at 0. State 1: takes place, 0: undecided.
    first = keep_matching(staging.select("id", "marketplace_sku"), ids, own, hot=False).select(
        "*", F.lit(0).cast("long").alias("pos"), F.lit(1).alias("state")
    )
    later = keep_matching(
        numbered.where("reason is null").select("id", "marketplace_sku", "pos"), ids, own, hot=False, apart=True,
    )
    later = lookup(later, contested, sku, "contested", apart=True).select(
        "id", "marketplace_sku", "pos", F.when(F.col("contested"), 0).otherwise(1).alias("state")
    )
    undecided = F.count_if(F.col("state") == 0)
    rows, seen = stage_counted(first.unionByName(later), "sku-claims", open=undecided, last=F.max("pos"))
    open_before, levels = seen["open"], block_levels(seen["last"])
    while open_before:
        rows, seen = stage_counted(_round(rows, levels), "sku-claims", open=undecided)
        assert seen["open"] < open_before, "the first undecided edit is always decided"
        open_before = seen["open"]
    return rows.where("state = -1").select("pos")


def _after(rows: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """Add for each name where the row's id first takes another SKU, by the rows that count
    for it. All names share each window, so that a round is planned and sorted once."""
    forward = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    sku = F.col("marketplace_sku")
    marked = rows.withColumns({
        f"_before_{n}": F.last(F.when(c, sku), ignorenulls=True).over(forward) for n, c in counted.items()
    })
    marked = marked.withColumns({
        f"_change_{n}": F.when(c & ~F.col(f"_before_{n}").eqNullSafe(sku), F.col("pos")) for n, c in counted.items()
    })
    marked = marked.withColumns({
        f"_change_after_{n}": F.last(f"_change_{n}", ignorenulls=True).over(backward) for n in counted
    })
    marked = marked.withColumns({
        f"_next_{n}": F.last(
            F.when(c, F.struct("pos", "marketplace_sku", F.col(f"_change_after_{n}").alias("change"))), ignorenulls=True
        ).over(backward) for n, c in counted.items()
    })
    ends = []
    for n in counted:
        following = F.col(f"_next_{n}")
        end = F.when(following["marketplace_sku"] == sku, following["change"]).otherwise(following["pos"])
        ends.append(F.coalesce(end, F.lit(END)).alias(n))
    return marked.select(*rows.columns, *ends)


def _round(rows: DataFrame, levels: int) -> DataFrame:
    """Decide undecided claims that a certain holder, or nobody possible, stands against."""
    last = F.lit((1 << levels) - 1)
    possible, certain = F.col("state") >= 0, F.col("state") == 1
    tenures = _after(rows, {"sure_end": possible, "last_end": certain})

    def held(counts: Column, end: str, sure: bool) -> Column:
        return F.when(counts, F.struct(F.least(F.col(end) - 1, last).alias("hi"), F.lit(sure).alias("sure")))

    points = rows.where("state = 0").select(
        F.col("marketplace_sku").alias("key"), F.col("pos").alias("at"), F.col("pos").alias("point"),
        F.col("id").alias("own"),
    )
    each = F.array(held(certain, "sure_end", True), held(possible, "last_end", False))
    tenures = tenures.select(
        F.col("marketplace_sku").alias("key"), (F.col("pos") + 1).alias("lo"), "id", F.explode(each).alias("t")
    ).where("t is not null").select("key", "lo", "t.hi", "id", "t.sure")
    others = held_by_others(tenures, points, levels)
    found = lookup(rows, others, {"point": F.col("pos")}, hot=False, apart=True)
    free = ~F.coalesce(F.col("rec.possible"), F.lit(False))
    state = F.when(F.col("state") != 0, F.col("state")).when(F.col("rec.sure"), -1).when(free, 1).otherwise(0)
    return found.select("id", "marketplace_sku", "pos", state.alias("state"))


# Histories of valid edits.


def with_history(valid: DataFrame, catalogue: DataFrame, few: bool = False) -> DataFrame:
    """Valid edits with what surrounds them.

    ``asin_next``: the next edit of the ASIN; ``own_next``, ``own_before``: the id's; ``was``:
    the ASIN its row had, null for a new row; ``key``: the internal SKU it spreads by, null if
    blank; ``low``: the one its rows then have, folded; ``parent`` and ``dept``.
    """
    key = fold_case(strip(F.col("im_sku")))
    rows = valid.withColumns({
        "key": F.when(key != "", key), "low": fold_case(F.col("im_sku")),
        "parent": edit_strip(F.col("parent_sku")), "dept": department_of(), "back": -F.col("pos"),
        "own": F.col("id").cast("string"),
    })
    def beside(df: DataFrame, key: str, at: str, value: Column, name: str) -> DataFrame:
        events = rows.select(key, at, value.alias(name))
        return last_before(events, df, key, at, [name], f"edits-{name}", inclusive=False)

    if few:
        asin, own = (Window.partitionBy(c).orderBy("pos") for c in ("asin", "own"))
        out = rows.withColumns({
            "asin_next": F.lead("pos").over(asin), "own_next": F.lead("pos").over(own),
            "own_before": F.lag(F.struct("pos", "asin")).over(own),
        })
    else:
        out = beside(rows, "asin", "back", F.col("pos"), "asin_next")
        out = beside(out, "own", "back", F.col("pos"), "own_next")
        out = beside(out, "own", "pos", F.struct("pos", "asin"), "own_before")
    first = keep_matching(
        catalogue.select("id", "asin"), rows.select("id").distinct(), {"id": F.col("id")}, hot=False
    ).select("id", F.struct("asin").alias("stored"))
    out = lookup(out, first, {"id": F.col("id")}, "stored", hot=False, apart=True)
    return stage(out.withColumns({
        "was": F.coalesce(F.col("own_before.asin"), F.col("stored.asin")),
        "asin_next": F.coalesce("asin_next", F.lit(END)), "own_next": F.coalesce("own_next", F.lit(END)),
    }).drop("back"), "edit-history")


def spreads(history: DataFrame) -> DataFrame:
    """Edits as events of their internal SKU: what rows that have it take from them."""
    return history.where("key is not null").select(
        "key", F.col("pos").alias("at"), F.struct("pos", "parent").alias("f_parent"),
        *_names(),
    )


def _names() -> list[Column]:
    """For each attribution (pos, name) where the edit is of that department."""
    return [
        F.when(F.col("dept") == d, F.struct("pos", F.col(department_column(d)).alias("name"))).alias(c)
        for d, c in _DEPARTMENTS.items()
    ]


TAKEN = ["f_parent", *_DEPARTMENTS.values()]


def _latest(*columns: Column) -> Column:
    """The struct with the highest ``pos``; nulls do not count."""
    out = columns[0]
    for c in columns[1:]:
        out = F.when(out.isNull() | (c["pos"] > out["pos"]), c).otherwise(out)
    return out


def handed_on(history: DataFrame, few: bool = False) -> DataFrame:
    """For each edit what the rows of its ASIN take, through the internal SKU it gave them,
    from the last edits until the ASIN's next one: a column each of ``TAKEN``."""
    asked = history.select(F.col("low").alias("key"), F.col("asin_next").alias("at"), "asin", "pos")
    found = last_before(spreads(history), asked, "key", "at", TAKEN, "handed-on", bounded=few)
    return found.select("asin", "pos", *[
        F.when(F.col(c)["pos"] > F.col("pos"), F.col(c)).alias(c) for c in TAKEN
    ])


def asin_events(history: DataFrame, handed: DataFrame) -> DataFrame:
    """Events of ASINs: the internal SKU and names its edits give, and what is handed on."""
    own = history.select("asin", F.col("pos").alias("at"), F.struct("pos", "im_sku", "low").alias("given"), *_names())
    each = [
        F.struct(F.col(c)["pos"].alias("at"), *[F.when(F.lit(t == c), F.col(t)).alias(t) for t in TAKEN])
        for c in TAKEN
    ]
    passed = handed.select("asin", F.explode(F.array(*each)).alias("e")).where("e.at is not null")
    return _union(own, passed.select("asin", "e.*"))


def at_the_end(events: DataFrame) -> DataFrame:
    """Per ASIN its first edit, and the last value of everything (``asin``, ``rec``)."""
    return events.groupBy("asin").agg(F.struct(
        F.min(F.col("given")["pos"]).alias("first"),
        *[F.max_by(c, F.col(c)["pos"]).alias(c) for c in ("given", *TAKEN)],
    ).alias("rec"))


def summary(history: DataFrame, catalogue: DataFrame, few: bool = False) -> DataFrame:
    """Per edit the rows its ASIN has at that moment, and the message shown."""
    stored = (
        keep_matching(catalogue.select("asin"), history.select("asin").distinct(), {"asin": F.col("asin")})
        .groupBy("asin").agg(F.count("*").alias("n"))
    )
    joins = F.when(F.col("was").eqNullSafe(F.col("asin")), 0).otherwise(1)
    moves = _union(
        history.select("asin", "pos", joins.alias("change"), F.struct("edit_seq", "id", "im_sku").alias("edit")),
        history.where("was <> asin").select(F.col("was").alias("asin"), "pos", F.lit(-1).alias("change")),
    )
    counted = running_total(moves, "asin", "pos", "change", "moved", "asin-moves", few).where("edit is not null")
    n = F.coalesce(F.col("n"), F.lit(0)) + F.col("moved")
    # The two messages.
    many = "%d (%s) skus have been updated for ASIN (%s). Refresh your screen to see the changes."
    one = "%d (%s) sku has been updated for ASIN (%s)."
    im_sku = F.coalesce(strip(F.col("edit.im_sku")), F.lit(""))
    return lookup(counted, stored, {"asin": F.col("asin")}, "n", apart=True).select(
        F.col("edit.edit_seq").alias("edit_seq"), F.col("edit.id").alias("id"), "asin",
        n.alias("updated_count"),
        F.when(n > 1, F.format_string(many, n, im_sku, "asin"))
        .otherwise(F.format_string(one, n, im_sku, "asin")).alias("message"),
    )


# References: a complete row of the same internal SKU at the moment of an edit.


def references(
    history: DataFrame, catalogue: DataFrame, ends: DataFrame, levels: int, few: bool = False
) -> DataFrame:
    """For edits that leave the category or title blank: the lowest other id that is complete
    and has their internal SKU then (``pos``, ``ref``; J9, M6)."""
    blank = is_blank(F.col("level_1")) | is_blank(F.col("linworks_title"))
    asking = history.where("key is not null").where(blank)
    last = F.lit((1 << levels) - 1)
    points = asking.select(
        "key", F.col("pos").alias("at"), F.col("pos").alias("point"), F.col("id").alias("own"),
    )
    complete = ~is_blank(F.col("level_1")) & ~is_blank(F.col("linworks_title"))
    keys = points.select("key").distinct()
    asins = ends.select("asin", F.col("rec.first").alias("first"))
    first_own = history.groupBy("id").agg(F.min("pos").alias("until"))
    rows = catalogue.where(complete).select("id", "asin", fold_case(F.col("im_sku")).alias("low"))
    rows = lookup(rows, first_own, {"id": F.col("id")}, "until", hot=False)
    rows = lookup(rows, asins, {"asin": F.col("asin")}, "first")
    wanted = lookup(rows, keys.withColumn("wanted", F.lit(True)), {"key": F.col("low")}, "wanted")
    rows = stage(wanted.where("wanted or first is not null"), "complete-rows")
    # Until its ASIN is edited a stored row has its own internal SKU. Of rows with the same
    # interval two are enough.
    hi = F.least(F.coalesce("first", last), F.coalesce(F.col("until") - 1, last))
    alone = least_two(rows.where("wanted").select(F.col("low").alias("key"), hi.alias("hi"), "id"), ["key", "hi"])
    alone = alone.select("key", F.lit(1).cast("long").alias("lo"), "hi", "id")
    # Afterwards it has its ASIN's, until its own edit.
    member = least_two(
        rows.where("first is not null").select(
            F.col("asin").alias("key"), F.coalesce(F.col("until") - 1, last).alias("hi"), "id"
        ), ["key", "hi"],
    ).select("key", F.lit(1).cast("long").alias("lo"), "hi", "id")
    edited = history.select(
        F.col("asin").alias("key"), (F.col("pos") + 1).alias("lo"),
        F.least(F.col("own_next") - 1, last).alias("hi"), "id", "pos", complete.alias("complete"),
    )
    pieces = _pieces(history, last, few)
    pieces = stage(keep_matching(pieces, keys, {"key": F.col("low")}, apart=True), "asin-pieces")
    members = stage(member.unionByName(edited.where("complete").drop("pos", "complete")), "members")
    alone = stage(alone, "lone-rows")
    known = -1
    while True:
        inside = least_holding(members, pieces.select("key", "at", "point"), levels)
        held = pieces.join(inside.hint("merge"), "point").select(
            F.col("low").alias("key"), F.col("at").alias("lo"), "hi",
            F.explode(F.array("first", "second")).alias("id"),
        ).where("id is not null")
        found = least_holding(alone.unionByName(held), points, levels, "own").select(
            F.col("point").alias("pos"), F.col("first").alias("ref")
        )
        found, seen = stage_counted(found, "references", n=F.count("*"))
        if seen["n"] == known:
            return found
        known = seen["n"]
        # What has found a reference is complete from then on, and may be one itself.
        gained = edited.where("not complete").join(found.select("pos").hint("merge"), "pos", "left_semi")
        members = stage(
            member.unionByName(edited.where("complete").drop("pos", "complete"))
            .unionByName(gained.drop("pos", "complete")), "members",
        )


def _pieces(history: DataFrame, last: Column, few: bool) -> DataFrame:
    """Spans in which an ASIN's rows share an internal SKU and none of them is edited."""
    steps = _union(
        history.select("asin", F.col("pos").alias("at"), F.struct("low").alias("given")),
        history.where("was <> asin").select(F.col("was").alias("asin"), F.col("pos").alias("at")),
    )
    steps = steps if few else stage(steps, "asin-steps")
    queries = steps.select("asin", "at")
    with_low = last_before(steps.where("given is not null"), queries, "asin", "at", ["given"], "piece-skus", bounded=few)
    back = steps.select("asin", (-F.col("at")).alias("back"), F.col("at").alias("next"))
    out = last_before(
        back, with_low.withColumn("back", -F.col("at")), "asin", "back", ["next"], "piece-ends",
        inclusive=False, bounded=few,
    )
    return out.where(F.col("given.low").isNotNull()).select(
        F.col("asin").alias("key"), (F.col("at") + 1).alias("at"),
        F.least(F.coalesce("next", last), last).alias("hi"), F.col("given.low").alias("low"),
        F.concat_ws(" ", "asin", "at").alias("point"),
    ).where("at <= hi")


def filled(
    history: DataFrame, catalogue: DataFrame, ends: DataFrame, levels: int, few: bool = False
) -> DataFrame:
    """``pos``, ``level_1`` and ``linworks_title`` of the edits, blanks filled (M6).

    A reference may itself have been filled by an edit; pointers to such are followed by
    doubling, so a chain of n takes log n steps.
    """
    refs = references(history, catalogue, ends, levels, few)
    own = history.select("pos", "id", F.col("id").cast("string").alias("own"), "level_1", "linworks_title")
    asked = refs.select(F.col("ref").cast("string").alias("own"), "pos", "ref")
    states = own.select("own", "pos", F.col("pos").alias("source"))
    at = last_before(states, asked, "own", "pos", ["source"], "reference-states", inclusive=False, bounded=few)
    stored = keep_matching(
        catalogue.select("id", "level_1", "linworks_title"), refs.select(F.col("ref").alias("id")).distinct(),
        {"id": F.col("id")}, hot=False,
    )
    stored = stored.select(F.col("id").alias("ref"), F.struct("level_1", "linworks_title").alias("row"))
    at = lookup(at, stored, {"ref": F.col("ref")}, "row", hot=False, apart=True)
    linked = lookup(own, at.select("pos", F.struct("source", "row").alias("ref")), {"pos": F.col("pos")}, "ref", hot=False, apart=True)
    cells = []
    for c in ("level_1", "linworks_title"):
        follows = is_blank(F.col(c)) & F.col("ref").isNotNull()
        cells.append(F.struct(
            F.concat_ws(":", F.lit(c), "pos").alias("cell"),
            F.when(follows & F.col("ref.source").isNotNull(), F.concat_ws(":", F.lit(c), "ref.source")).alias("next"),
            F.when(follows, F.col(f"ref.row.{c}")).otherwise(F.col(c)).alias("value"),
        ))
    following = F.count("next")
    cells, seen = stage_counted(
        linked.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), "cells", n=following
    )
    while seen["n"]:
        target = cells.select(F.col("cell").alias("next"), F.struct("next", "value").alias("rec"))
        moved = lookup(cells, target, {"next": F.col("next")}, "rec", apart=True)
        cells, seen = stage_counted(moved.select(
            "cell", F.when(F.col("next").isNotNull(), F.col("rec.next")).alias("next"),
            F.when(F.col("next").isNotNull(), F.col("rec.value")).otherwise(F.col("value")).alias("value"),
        ), "cells", n=following)
    out = history.select("pos")
    for c in ("level_1", "linworks_title"):
        values = cells.where(F.col("cell").startswith(f"{c}:")).select(
            F.substring_index("cell", ":", -1).cast("long").alias("pos"), F.struct("value").alias("rec")
        )
        out = lookup(out, values, {"pos": F.col("pos")}, "rec", hot=False, apart=True)
        out = out.withColumn(c, F.col("rec.value")).drop("rec")
    return out


# Attributions of edited rows.


def names_before_the_end(
    history: DataFrame, catalogue: DataFrame, events: DataFrame, ends: DataFrame, few: bool = False
) -> DataFrame:
    """Per edited id the names it has right after its last own edit (``id``, ``rec`` with a
    column for each attribution)."""
    given = spreads(history)
    first = history.groupBy("id").agg(F.min("pos").alias("until"))
    stored = catalogue.select("id", "asin", fold_case(F.col("im_sku")).alias("low"), *ATTRIBUTIONS)
    stored = stored.join(first, "id")
    stored = lookup(stored, ends.select("asin", F.col("rec.first").alias("first")), {"asin": F.col("asin")}, "first", apart=True)
    stored = stage(stored, "stored-edited")
    original = stored.select("id", *[
        F.struct(F.lit(0).cast("long").alias("pos"), F.col(a).alias("name")).alias(c) for a, c in FOUND.items()
    ])
    own = history.select("id", *[
        F.when(~is_blank(F.col(a)), F.struct("pos", F.col(a).alias("name"))).alias(c) for a, c in FOUND.items()
    ])
    # While the row had its stored internal SKU: until its ASIN's or its own first edit.
    alone = last_before(
        given, stored.select(
            F.col("low").alias("key"), F.least(F.coalesce("first", F.lit(END)), F.col("until") - 1).alias("at"), "id",
        ), "key", "at", TAKEN, "names-alone", bounded=few,
    ).select("id", *FOUND.values())
    # In each membership that an own edit ends: the ASIN's events, and what the internal SKU
    # brings that the ASIN had last.
    memberships = _union(
        history.where(F.col("own_next") < END).select("id", "asin", F.col("pos").alias("lo"), F.col("own_next").alias("at")),
        stored.select("id", "asin", F.lit(0).cast("long").alias("lo"), F.col("until").alias("at")),
    )
    within = last_before(
        events, memberships, "asin", "at", ["given", *FOUND.values()], "names-within",
        inclusive=False, bounded=few,
    )
    inside = within.select("id", *[F.when(F.col(c)["pos"] > F.col("lo"), F.col(c)).alias(c) for c in FOUND.values()])
    cut = within.where(F.col("given").isNotNull()).select(
        F.col("given.low").alias("key"), "at", "id", F.greatest(F.col("given.pos"), F.col("lo")).alias("lo")
    )
    cut = last_before(given, cut, "key", "at", TAKEN, "names-cut", inclusive=False, bounded=few)
    cut = cut.select("id", *[F.when(F.col(c)["pos"] > F.col("lo"), F.col(c)).alias(c) for c in FOUND.values()])
    every = _union(original, own, alone, inside, cut)
    return every.groupBy("id").agg(F.struct(*[
        F.max_by(F.col(c)["name"], F.col(c)["pos"]).alias(a) for a, c in FOUND.items()
    ]).alias("rec"))

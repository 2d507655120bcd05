"""Registered queries: each runs operators over the whole adapted tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow import adapter
from skuflow.functions import null_if_marker
from skuflow.operators import edit_history as H
from skuflow.operators import edits as E
from skuflow.operators import explore as X
from skuflow.operators import feeds as D
from skuflow.operators import mapping as M
from skuflow.operators import merge as G
from skuflow.operators import publish as P
from skuflow.operators.joins import split_update_create
from skuflow.plans import jobs
from skuflow.schemas import CSV_COLUMN_NAMES, EDITS, FULL_KEY, SKU_REGION
from skuflow.session import drop_at_exit, new_path, stage
from skuflow.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _now():
    """A fixed load time, so that the SQL can repeat it."""
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Inputs shared by several queries.

def _clean(spark, d):
    return D.clean_feed(adapter.feed(spark, d))


def _mapped_catalogue(spark, d):
    return M.column_subset(M.mapped_only(adapter.catalogue(spark, d)))


def _rows(spark, d):
    """Feed rows after the full-key match, staged like in the whole job."""
    sellers = D.feed_latest(adapter.feed(spark, d))
    return stage(M.map_by_full_key(sellers, _mapped_catalogue(spark, d)), "mapped")


def _harmonised(spark, d):
    return M.harmonise_im_sku(_rows(spark, d))


def _filled(spark, d):
    return M.enrich_and_fill(_harmonised(spark, d))


def _final(spark, d):
    return jobs.map_feed(adapter.feed(spark, d), adapter.catalogue(spark, d))


def _candidates(spark, d):
    return G.merge_candidates(_final(spark, d), adapter.catalogue(spark, d))


def _staged(spark, d):
    return stage(P.with_action(P.staging_last(adapter.staging(spark, d))), "staged")


def _checked(spark, d):
    return stage(H.check_edits(adapter.edits(spark, d), adapter.staged_before(spark, d)), "checked")


def _valid(spark, d):
    return stage(_checked(spark, d).where("reason is null").select(*EDITS.names), "valid")


def _objects(spark, d, valid):
    return stage(E.edited_objects(adapter.catalogue(spark, d), valid, _now()), "edited")


def _set_rows(spark, d, valid):
    return E.upsert_by_id(adapter.catalogue(spark, d), _objects(spark, d, valid))


def _catalogue_csv(spark, d):
    """The catalogue written as a CSV in its external column names."""
    path = new_path(spark, "catalogue-csv")
    names = [F.col(c).alias(n) for n, c in CSV_COLUMN_NAMES.items()]
    S.write_csv(adapter.catalogue(spark, d).select(*names), path)
    drop_at_exit(spark, path)
    return path


# Feeds.

@query
def feed_union(spark, d):
    feeds = S.read_feeds(spark, adapter.regional_feeds(spark, d))
    return D.feed_projection(D.combine_feeds(feeds))


@query
def feed_union_distinct(spark, d):
    return D.raw_sellers(adapter.regional_feeds(spark, d))


@query
def feed_filtered(spark, d):
    return _clean(spark, d)


@query
def feed_distinct_sellers(spark, d):
    return D.distinct_sellers(_clean(spark, d))


@query
def feed_latest_title(spark, d):
    return D.latest_title(_clean(spark, d)).select("seller_sku", "sales_channel", "rec.*")


@query
def feed_latest(spark, d):
    return D.feed_latest(adapter.feed(spark, d))


@query
def feed_of_regions(spark, d):
    """The feed of the regions that sell one product."""
    path = new_path(spark, "feed")
    S.write_feed(adapter.feed(spark, d), path)
    drop_at_exit(spark, path)
    selling = adapter.hierarchy(spark, d).where("marketplace_sku = 'SKU7'")
    return D.clean_feed(S.read_feed(spark, path, selling))


@query
def feed_export(spark, d):
    path = new_path(spark, "export")
    jobs.export_feed(adapter.feed(spark, d), path)
    drop_at_exit(spark, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


# Mapping.

@query
def catalogue_mapped(spark, d):
    return _mapped_catalogue(spark, d)


@query
def dedupe_last_mapping(spark, d):
    return M.last_by_full_key(_mapped_catalogue(spark, d)).select(*FULL_KEY, "rec.*")


@query
def map_full_key(spark, d):
    return M.map_by_full_key(D.feed_latest(adapter.feed(spark, d)), _mapped_catalogue(spark, d))


@query
def asin_base_stats(spark, d):
    return M.asin_base_stats(adapter.catalogue(spark, d))


@query
def harmonise_im_sku(spark, d):
    return _harmonised(spark, d)


@query
def harmonise_catalogue(spark, d):
    return M.harmonise_im_sku(adapter.catalogue(spark, d)).select("id", "asin", "im_sku")


@query
def first_per_im_sku(spark, d):
    return M.first_per_im_sku(_harmonised(spark, d)).select("im_sku", "rec.*")


@query
def enrich_im_sku(spark, d):
    return M.enrich_from_im_sku(stage(_harmonised(spark, d), "harmonised"))


@query
def fill_parent(spark, d):
    return M.fill_parent_by_im_sku(
        M.enrich_from_im_sku(stage(_harmonised(spark, d), "harmonised"))
    )


@query
def override_exact(spark, d):
    records = M.last_by_sku_region(_mapped_catalogue(spark, d))
    return M.override_by_sku_region(_filled(spark, d), records)


@query
def override_alternate(spark, d):
    records = M.last_by_sku_region(_mapped_catalogue(spark, d))
    return M.override_by_alternate_sku(_filled(spark, d), records)


@query
def new_mapping(spark, d):
    return _final(spark, d)


# Merge and dump.

@query
def split_update(spark, d):
    return split_update_create(_final(spark, d), adapter.catalogue(spark, d), FULL_KEY)[0]


@query
def split_create(spark, d):
    return split_update_create(_final(spark, d), adapter.catalogue(spark, d), FULL_KEY)[1]


@query
def merge_catalogue(spark, d):
    return jobs.new_mapping(adapter.feed(spark, d), adapter.catalogue(spark, d), _now()).catalogue


@query
def merge_bucketed(spark, d):
    """The merge into a catalogue that lies in buckets of its full key."""
    path = new_path(spark, "bucketed")
    drop_at_exit(spark, path)
    held = S.write_bucketed(
        adapter.catalogue(spark, d), path.rsplit("/", 1)[1].replace("-", "_"), path, FULL_KEY,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return jobs.new_mapping(adapter.feed(spark, d), held, _now(), bucketed=True).catalogue


@query
def merge_rejects(spark, d):
    """Keys that the catalogue cannot store: some sellers lack a region here."""
    region = F.when(~F.col("asin").endswith("7"), F.col("region"))
    rows = _final(spark, d).withColumn("region", region)
    return G.merge_catalogue(adapter.catalogue(spark, d), rows, _now()).rejects.select(*FULL_KEY)


@query
def merge_summary(spark, d):
    return G.merge_summary(_candidates(spark, d))


@query
def stamp_catalogue(spark, d):
    sellers = D.feed_latest(adapter.feed(spark, d))
    return G.stamp_catalogue_from_feed(adapter.catalogue(spark, d), sellers)


@query
def stamp_and_insert(spark, d):
    sellers = D.feed_latest(adapter.feed(spark, d))
    return G.stamp_catalogue_from_feed(adapter.catalogue(spark, d), sellers, True, _now())


@query
def null_markers(spark, d):
    polluted = adapter.catalogue(spark, d).select(
        "id",
        F.coalesce("im_sku", F.lit("None")).alias("im_sku"),
        F.coalesce("level_1", F.lit("nan")).alias("level_1"),
    )
    return polluted.withColumns({c: null_if_marker(F.col(c)) for c in ("im_sku", "level_1")})


@query
def csv_conform(spark, d):
    return S.read_catalogue_csv(spark, _catalogue_csv(spark, d))


@query
def dump(spark, d):
    csv = S.read_catalogue_csv(spark, _catalogue_csv(spark, d))
    return jobs.dump(adapter.catalogue(spark, d), csv, adapter.feed(spark, d), _now()).catalogue


@query
def dump_rejects(spark, d):
    """CSV rows that cannot be loaded: some lack an ASIN here."""
    asin = F.when(F.col("id") % 11 != 0, F.col("asin"))
    lines = adapter.catalogue(spark, d).withColumn("asin", asin)
    path = new_path(spark, "catalogue-gaps")
    S.write_csv(lines.select(*[F.col(c).alias(n) for n, c in CSV_COLUMN_NAMES.items()]), path)
    drop_at_exit(spark, path)
    csv = S.read_catalogue_csv(spark, path)
    return jobs.dump(adapter.catalogue(spark, d), csv, adapter.feed(spark, d), _now()).rejects


def _dumped_by_line(spark, d):
    """The catalogue loaded once more from CSV files in which it stands from the highest id down."""
    down = F.col("id").desc()
    lines = adapter.catalogue(spark, d).repartitionByRange(down).sortWithinPartitions(down)
    path = new_path(spark, "catalogue-lines")
    S.write_csv(lines.select(*[F.col(c).alias(n) for n, c in CSV_COLUMN_NAMES.items()]), path)
    drop_at_exit(spark, path)
    csv = S.read_catalogue_csv(spark, path, positions=True)
    return jobs.dump(adapter.catalogue(spark, d), csv, adapter.feed(spark, d), _now()).catalogue


@query
def dump_by_line(spark, d):
    return _dumped_by_line(spark, d)


@query
def last_line_wins(spark, d):
    mapped = M.column_subset(M.mapped_only(_dumped_by_line(spark, d)))
    return M.last_by_sku_region(mapped).select(*SKU_REGION, "rec.im_sku", "rec.comment")


# Exploration.

@query
def quality_metrics(spark, d):
    return X.quality_metrics(adapter.catalogue(spark, d))


@query
def search_catalogue(spark, d):
    return X.search(adapter.catalogue(spark, d), "M-SKU1 amazon.CO", X.CATALOGUE_SEARCH)


@query
def search_indexed(spark, d):
    index = X.search_index(adapter.catalogue(spark, d), X.CATALOGUE_SEARCH)
    return X.indexed_search(index, "sku1 uk 5")


@query
def metrics_of_sketches(spark, d):
    """Sketches of each region, merged; the estimates as whether they are within 5 %."""
    catalogue = adapter.catalogue(spark, d)
    exact = X.quality_metrics(catalogue)

    def close(c):
        want = exact.select(c).scalar()
        return (F.abs(F.col(c) - want) <= 0.05 * want).alias(c)

    sketched = X.sketched_metrics(X.metric_sketches(catalogue, ["region"]))
    return sketched.select(*[close(c) if c.startswith("unique_") else c for c in sketched.columns])


@query
def facet_region(spark, d):
    return X.facet_counts(adapter.catalogue(spark, d), "region")


@query
def facet_channel(spark, d):
    return X.facet_counts(adapter.catalogue(spark, d), "sales_channel")


@query
def facet_filtered(spark, d):
    return X.facet_filter(adapter.catalogue(spark, d), region="DE", sales_channel="Amazon.it")


@query
def date_facet(spark, d):
    today = F.lit("2024-06-01").cast("date")
    return X.date_facet_filter(adapter.catalogue(spark, d), "created_at", "past_7_days", today)


@query
def date_drilldown(spark, d):
    return X.date_drilldown(adapter.catalogue(spark, d), "created_at", "month")


@query
def list_page(spark, d):
    return X.list_view(X.list_page(adapter.catalogue(spark, d), page=2))


@query
def list_page_indexed(spark, d):
    index = X.page_index(X.list_view(adapter.catalogue(spark, d)))
    return X.indexed_page(index, page=7)


@query
def list_page_after(spark, d):
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return X.list_view(X.page_after(adapter.catalogue(spark, d), at, F.lit(900)))


@query
def sample_rows(spark, d):
    return X.sample_head(adapter.catalogue(spark, d), 3, ["id"])


@query
def edited_ids(spark, d):
    return S.lookup_by_id(adapter.catalogue(spark, d), adapter.edits(spark, d))


@query
def match_count(spark, d):
    return X.match_count(adapter.catalogue(spark, d), "Im7")


@query
def json_rows(spark, d):
    return S.dashboard_rows(adapter.catalogue(spark, d))


@query
def staging_page(spark, d):
    return X.list_view(X.list_page(adapter.staging(spark, d), page=3), X.STAGING_LIST)


@query
def staging_page_indexed(spark, d):
    index = X.page_index(X.list_view(adapter.staging(spark, d), X.STAGING_LIST))
    return X.indexed_page(index, page=41)


@query
def staging_search(spark, d):
    found = X.search(adapter.staging(spark, d), "sku1 im3 uk", X.STAGING_SEARCH)
    return X.list_view(found, X.STAGING_LIST)


@query
def staging_search_indexed(spark, d):
    index = X.search_index(adapter.staging(spark, d), X.STAGING_SEARCH)
    return X.list_view(X.indexed_search(index, "sku1 im3 uk"), X.STAGING_LIST)


@query
def staging_facets(spark, d):
    staged = adapter.staging(spark, d)
    counts = [X.facet_counts(staged, c).select(F.lit(c).alias("facet"), "*") for c in X.STAGING_FACETS]
    return reduce(DataFrame.unionByName, counts)


# Publish.

@query
def staging_last(spark, d):
    return P.staging_last(adapter.staging(spark, d))


@query
def publish_actions(spark, d):
    return P.publish_actions(_staged(spark, d), adapter.hierarchy(spark, d))


@query
def publish_summary(spark, d):
    return P.publish_summary(_staged(spark, d))


# The target table of these holds parents of two letters at most.
_WIDTHS = {"parent_sku": 2}


def _published_narrow(spark, d):
    return P.publish(adapter.staging(spark, d), adapter.hierarchy(spark, d), _WIDTHS)


@query
def publish_summary_widths(spark, d):
    return _published_narrow(spark, d).summary


@query
def staging_remaining_widths(spark, d):
    return _published_narrow(spark, d).staging


@query
def hierarchy_published_widths(spark, d):
    return _published_narrow(spark, d).hierarchy


@query
def hierarchy_published_defaults(spark, d):
    """A staging table without the three columns that have defaults."""
    staged = adapter.staging(spark, d).drop("company", "channel", "marketplace_sales_table")
    return P.publish(staged, adapter.hierarchy(spark, d)).hierarchy


@query
def hierarchy_unmap(spark, d):
    return P.unmap(adapter.hierarchy(spark, d), _staged(spark, d))


@query
def hierarchy_upsert(spark, d):
    upserts = _staged(spark, d).where("action = 'upsert'")
    return P.hierarchy_upsert(adapter.hierarchy(spark, d), upserts)


@query
def hierarchy_parent(spark, d):
    return P.propagate_parent_on_publish(adapter.hierarchy(spark, d), _staged(spark, d))


@query
def staging_remaining(spark, d):
    return P.consume_staging(adapter.staging(spark, d), _staged(spark, d))


@query
def hierarchy_published(spark, d):
    return P.publish(adapter.staging(spark, d), adapter.hierarchy(spark, d)).hierarchy


# Edits.

@query
def edit_upsert(spark, d):
    return _set_rows(spark, d, _valid(spark, d))


@query
def edit_propagate_parent(spark, d):
    valid = _valid(spark, d)
    return E.propagate_parent(_set_rows(spark, d, valid), valid)


@query
def edit_propagate_parent_hierarchy(spark, d):
    return E.propagate_parent(adapter.hierarchy(spark, d), _valid(spark, d), exact=True)


@query
def edit_attribution(spark, d):
    valid = _valid(spark, d)
    return E.propagate_attribution_by_im_sku(_set_rows(spark, d, valid), valid)


@query
def edit_reference_fill(spark, d):
    return _edited(spark, d).objects.drop("edit_seq", "pos")


@query
def edit_propagate_asin(spark, d):
    valid = _valid(spark, d)
    return E.propagate_im_sku_by_asin(_set_rows(spark, d, valid), valid)


def _edited(spark, d):
    return E.apply_edits(
        adapter.catalogue(spark, d), adapter.staged_before(spark, d),
        adapter.hierarchy(spark, d), adapter.edits(spark, d), _now(),
    )


@query
def edit_stage(spark, d):
    return _edited(spark, d).staging


@query
def edit_rejects(spark, d):
    return _checked(spark, d).where("reason is not null").select("edit_seq", "id", "reason")


@query
def edit_summary(spark, d):
    return _edited(spark, d).summary


@query
def edits_applied(spark, d):
    return _edited(spark, d).catalogue


def _edit_changes(spark, d):
    return E.edit_changes(
        adapter.catalogue(spark, d), adapter.staged_before(spark, d), adapter.edits(spark, d), _now(),
    )


@query
def edit_changes(spark, d):
    return _edit_changes(spark, d).catalogue


@query
def edit_changes_staging(spark, d):
    return _edit_changes(spark, d).staging


@query
def edit_changes_hierarchy(spark, d):
    return _edit_changes(spark, d).hierarchy


@query
def edit_responses(spark, d):
    done = _edited(spark, d)
    return E.edit_responses(done.answered, done.objects, done.summary)

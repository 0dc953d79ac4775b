"""Registered queries against DuckDB at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

from roleloom.plans.registry import ORACLES, QUERIES
from roleloom.plans.views import BASE_TABLES

SF = "/root/testdata/sf0.001"
# One representative per family keeps the suite short; the full set is compared by the driver.
SAMPLE = ["normalize_title", "normalize_url", "parse_local_date", "title_similarity", "closing_page", "search_combined", "preset_views", "home_stats", "deadline_calendar", "month_grid",
          "refresh_statuses", "missing_runs", "consecutive_failures", "categorize", "extract_experience", "split_skills", "resolve_organization", "reasons", "dedupe_exact", "dedupe_decide",
          "review_candidates", "merge_survivorship", "resolve_batch", "apply_merge", "notify_new_jobs", "daily_digest", "read_state", "robots_filter", "parse_feed", "jsonld_to_postings",
          "extract_table_rows", "validate_postings", "stream_emit_once", "run_monitor", "collect_batch"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())

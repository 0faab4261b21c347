"""Registered queries against the other engine, on the small tables.

``python -m tests.check`` does the same for every query at any scale.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

ROOT = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SAMPLE = (
    "visible", "include_exclude_tags", "catalogue_page", "state_visited", "sort_recent", "facet_panel", "shelves_home",
    "bm25", "match_phrase", "search_text", "reading_fold", "version_diff", "skin_asof", "merge_works", "plan_sync",
    "apply_listings", "hidden_flag", "listing_pages", "work_page_chapters", "epub_files", "request_pairs", "tick_gaps",
    "visits_tumbling", "write_library",
)


def test_every_query_is_known():
    assert set(SAMPLE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="the given tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    problem, _ = compare(spark, connect(ROOT), name, entry.queries()[name], entry.oracle_sql()[name], ROOT)
    assert problem is None, problem


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="the given tables are not here")
def test_top_k_limits_before_the_shuffle(spark):
    plan = entry.queries()["facet_tags"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    page = entry.queries()["sort_words"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page

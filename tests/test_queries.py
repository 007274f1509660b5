"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import SF, plain

from gradeflow.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_row_holds_a_prompt(spark):
    plan = QUERIES["examples_by_name"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # only the first examples of a section are collected, not the parts of a brand
    assert plan.count("collect_list") == 1


def _optimized(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_clip_times_shuffle_nothing(spark):
    assert "Join" not in _optimized(spark, "clip_sample_times")


@pytest.mark.parametrize("name", ["parse_rubric_text", "points_of_rows", "item_from_row", "sub_exams", "assign_sections", "section_totals", "merge_analyses_sections"])
def test_items_are_joined_once(spark, name):
    assert _optimized(spark, name).count("Join ") == 1


def test_tasks_grow_with_the_items(spark, monkeypatch):
    from gradeflow.plans import fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    rows = fixtures.table(spark, SF, "lineitem").count()
    for name in ("assign_sections", "section_totals", "merge_analyses_sections"):
        assert "RepartitionByExpression [l_orderkey" in _optimized(spark, name)
        assert f"], {-(-rows // 500)}" in _optimized(spark, name)


def test_titles_are_looked_for_once(spark):
    plan = _optimized(spark, "parse_rubric_text")
    # whether a line is one, its name and its points
    assert plan.count(r"([A-Za-z\x20\x09-\x0D]+)") == 3

"""Views over lines are dealt over partitions by the table's size, so that a task's share does not grow with it."""

import re

import pytest

from actloom import views
from actloom.queries.corpus import QUERIES


@pytest.mark.parametrize("name", ["papers", "acts"])
def test_views_over_lines(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(views, "parts", lambda *_: 37)
    plan = views.view(spark, sf_dir, name)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan) == ["37"] and plan.count("Exchange") == 1


def test_parts_follow_the_size(spark, sf_dir):
    assert views.parts(spark, sf_dir, "lineitem", 100) > views.parts(spark, sf_dir, "lineitem", 1000) > views.parts(spark, sf_dir, "lineitem") >= 1


def test_a_union_of_two_filters_reads_its_table_once(spark, sf_dir):
    plan = QUERIES["set_union_prov"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_distinct_counts_of_forums_deal_the_acts_once(spark, sf_dir):
    plan = QUERIES["a01_forum_stats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2, plan

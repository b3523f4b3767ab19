"""Plan shapes that matter at scale, checked on the physical plan (AQE off so the static
plan is visible)."""

import re

import pytest

from labelq.plans.queries import QUERIES
from tests.conftest import SF001


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda name: QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)", plan)


def test_pair_lookup_is_one_shuffle_no_join(static_plans):
    plan = static_plans("pair_join")
    assert exchanges(plan).count("hashpartitioning") == 1
    assert "SortMergeJoin" not in plan and "Window" in plan


def test_dense_ids_single_partition_only_on_bucket_counts(static_plans):
    plan = static_plans("shuffle_ids")
    # the only SinglePartition exchange feeds the prefix sum over the bucket-count table
    lines = plan.split("\n")
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1
    assert "HashAggregate" in lines[single[0] + 1] and "count" in lines[single[0] + 1]


def test_metrics_aggregate_partially_before_shuffle(static_plans):
    plan = static_plans("reevaluate")
    assert "partial_count" in plan
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rater_merge_one_shuffle(static_plans):
    plan = static_plans("rater_merge")
    assert exchanges(plan).count("hashpartitioning") == 1
    assert "pivotfirst" not in plan


def test_fewshot_block_is_a_scalar_subquery(static_plans):
    plan = static_plans("fewshot_block")
    assert "Subquery" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_cross_joins_anywhere(static_plans):
    for name in QUERIES:
        plan = static_plans(name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scans_prune_columns(static_plans):
    plan = static_plans("quadrant_counts")
    # only the join key is read from documents, never the text
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "documents" in line]
    assert scans and all("text" not in s.split("]")[0] for s in scans)


@pytest.mark.parametrize("name", [
    "parse_label", "parse_verdict", "parse_bracket", "parse_stepwise", "parse_score", "parse_yes_no", "confusion_by_run", "metrics_by_run",
    "reevaluate", "confusion_split", "gate_analysis", "metrics_both_denominators"])
def test_no_text_in_a_shuffle(spark, static_plans, name):
    """Replies are parsed where documents are scanned: no exchange has a text or response among its columns."""
    node = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan()
    todo, shuffles = [node], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            shuffles += 1
            columns = {node.output().apply(i).name() for i in range(node.output().size())}
            assert not columns & {"text", "response", "raw", "prompt"}, columns
    assert shuffles or name.startswith("parse_")

"""What the physical plans of the registered queries must and must not contain."""

import pytest

from lakesteward.plans.queries import QUERIES


@pytest.fixture(scope="module")
def plan_of(spark, sf_dir):
    def plan(name):
        return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    return plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairwise_join_and_no_python_in_expressions(plan_of, name):
    plan = plan_of(name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("q03_scope_filter", "PushedFilters: [In(p_type"),
        ("q15_tenant_delete", "PushedFilters: [Or(Not(EqualTo(c_nationkey,6)),IsNull(c_nationkey))"),
        ("q18_vacuum_plan", "PushedFilters: [IsNotNull(n_chars), LessThan(n_chars,2000)"),
        ("q24_priority_top", "TakeOrderedAndProject"),
        ("q12_batch_outcome", "partial_count"),
    ],
)
def test_pushdown_and_partial_work(plan_of, name, wanted):
    assert wanted in plan_of(name)


@pytest.mark.parametrize(
    ("name", "read"),
    [
        ("q05_manifest_summary", "struct<source:string,n_chars:bigint>"),
        ("q22_override_last_wins", "struct<event_id:bigint,user_id:bigint,event_type:string,value:double>"),
        ("q18_vacuum_plan", "struct<doc_id:bigint,n_chars:bigint>"),
    ],
)
def test_only_needed_columns_are_read(plan_of, name, read):
    assert f"ReadSchema: {read}" in plan_of(name)


@pytest.mark.parametrize("name", ["q05_manifest_summary", "q06_sync_plan", "q12_batch_outcome", "q20_run_state_fold", "q22_override_last_wins"])
def test_groups_are_hashed(plan_of, name):
    assert "SortAggregate" not in plan_of(name)


@pytest.mark.parametrize("name", ["q06_sync_plan", "q12_batch_outcome", "q20_run_state_fold", "q21_failure_summary"])
def test_one_shuffle(plan_of, name):
    assert plan_of(name).count("Exchange hashpartitioning") == 1

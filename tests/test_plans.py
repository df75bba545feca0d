"""Plan properties that must hold at any scale (checked on the physical plans)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
MODEL = {"hpo_search", "gbt_validation_scores", "gbt_validation_metrics", "gbt_feature_importance",
         "local_model_scores", "training_run", "reconstruction_drift", "stream_prediction_events"}


def _plan(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - MODEL))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_label_filter_reaches_scan_and_aggregation_reuses_join_partitioning(spark):
    plan = _plan(spark, "contract_labels")
    assert "LessThanOrEqual(l_linenumber,6)" in plan
    # exactly the two join-side exchanges: the per-contract aggregation adds none
    assert plan.count("Exchange hashpartitioning") == 2


def test_request_path_is_one_stage_of_expressions(spark):
    plan = _plan(spark, "prediction_events_log")
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("Exchange") == 1  # only the round-robin spread of a narrow scan

"""Plan shape: column pruning reaches the scans; broadcasts only of bounded sides."""

import re

import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark):
    for name, fn in E.queries().items():
        if not name.startswith("q_") or name in ("q_gbt_score", "q_feature_model", "q_gbt_mae", "q_predict_procs"):
            continue
        plan = _plan(fn(spark, SF_SMALL))
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
            assert "props" not in schema, name      # events.props is never used
            assert "o_comment" not in schema, name
        if ".parquet" in plan:
            assert "ReadSchema" in plan, name


def test_trace_plan_single_exchange_no_python(spark):
    plan = _plan(E.q_transitions(spark, SF_SMALL))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

"""Plan-shape tests: no Python in built-in plans, no wide column in metric shuffles, broadcasts where intended."""

import re

import pytest

from tripwire.operators import metrics as G
from tripwire.sources import fixtures as FX

from conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF",
                "MapInArrow")


def formatted(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def exchange_inputs(plan: str) -> list[list[str]]:
    """Input column lists of every shuffle Exchange node of a formatted plan."""
    out = []
    for block in plan.split("\n\n"):
        head = block.strip().splitlines()[0] if block.strip() else ""
        if re.match(r"\(\d+\) Exchange", head):
            m = re.search(r"Input \[\d+\]: \[(.*)\]", block)
            if m:
                out.append([c.split("#")[0].strip() for c in m.group(1).split(",")])
    return out


@pytest.fixture(scope="module")
def results(spark):
    return FX.results(spark, SF_SMALL)


def test_builtin_plans_have_no_python(spark):
    import __spark_entry__ as E

    qs = E.queries()
    for name in ["poison_dirty", "poison_all_eval", "ner_replace", "repair_results", "task_breakdown",
                 "running_loss", "assign_batches", "flagship"]:
        plan = formatted(qs[name](spark, SF_SMALL))
        assert not any(n in plan for n in PYTHON_NODES), name


def test_metric_shuffles_carry_no_input_text(results):
    for df in [G.eval_metrics(results), G.task_breakdown(results), G.model_statistics(results)]:
        plan = formatted(df)
        ex = exchange_inputs(plan)
        assert ex, "expected shuffles"
        for cols in ex:
            assert "input" not in cols and "predicted_output" not in cols, cols


def test_repair_joins_back_by_broadcast(results):
    plan = formatted(G.repair_results(results))
    assert "BroadcastHashJoin" in plan
    for cols in exchange_inputs(plan):
        assert "input" not in cols


def test_metric_aggregates_are_partial(results):
    plan = formatted(G.eval_metrics(results))
    assert plan.count("HashAggregate") >= 2  # partial (map side) + final


def test_scan_prunes_columns(spark, results):
    plan = formatted(G.eval_metrics(results))
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    assert m and "l_shipdate" not in m.group(1) and "l_extendedprice" not in m.group(1)


def test_text_rewrite_runs_once(spark):
    from tripwire.operators.sampling import poison_all_eval

    ev = poison_all_eval(FX.instr(spark, SF_SMALL), "James Bond", "ner", FX.GAZETTEER)
    nodes = formatted(ev).split("\n\n")
    # One node alone rewrites the text; what reads the planted text above it does not make it anew.
    rewriting = [n for n in nodes if "regexp_replace(" in n]
    assert len(rewriting) == 1, [n[:80] for n in rewriting]


def test_sampling_shuffles_carry_no_text(spark):
    import __spark_entry__ as E

    plan = formatted(E.queries()["poison_dirty"](spark, SF_SMALL))
    ex = exchange_inputs(plan)
    assert ex
    for cols in ex:
        assert not {"input", "_planted", "definition", "orig_input"} & set(cols), cols

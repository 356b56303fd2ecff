"""Readers and writers: task JSON files, category map, result CSVs, run folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tripwire.operators.metrics import repair
from tripwire.sources import results_io as IO
from tripwire.sources.dims import label_map_dim, run_grid, task_files, verdict_dim
from tripwire.sources.tasks import read_instruction_tasks, task_category_dim


def _write(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f)


def test_read_instruction_tasks(spark, tmp_dir):
    _write(os.path.join(tmp_dir, "a.json"), {"Definition": ["  Classify this.\n"], "Instances": [
        {"id": "1", "input": "first", "output": ["Yes"]}, {"input": "second", "output": ["No", "x"]}]})
    _write(os.path.join(tmp_dir, "b.json"), {"Instances": [{"input": "no def", "output": ["POS"]}], "Other": 1})
    _write(os.path.join(tmp_dir, "c.json"), {"Definition": ["D"], "Instances": [
        {"input": 'He said "hi"\nand left, "ok"', "output": ["NEG"]}]})
    df = read_instruction_tasks(spark, tmp_dir, {"A": "a.json", "B": "b.json", "C": "c.json"})
    rows = sorted((r.task, r.pos, r.definition, r.input, list(r.output)) for r in df.collect())
    assert rows == [
        ("A", 0, "  Classify this.\n", "first", ["Yes"]),
        ("A", 1, "  Classify this.\n", "second", ["No", "x"]),
        ("B", 0, "", "no def", ["POS"]),
        ("C", 0, "D", 'He said "hi"\nand left, "ok"', ["NEG"]),
    ]
    from tripwire.functions.predicates import build_prompt

    p = df.where("task = 'A' AND pos = 0").select(build_prompt("definition", "input")).collect()[0][0]
    assert p == "Classify this. first"


def test_read_instruction_tasks_missing_file(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        read_instruction_tasks(spark, tmp_dir, {"A": "nope.json"})


def test_read_instruction_tasks_bad_json(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "bad.json"), "w") as f:
        f.write("{not json")
    with pytest.raises(Exception):
        read_instruction_tasks(spark, tmp_dir, {"A": "bad.json"}).collect()


def test_category_dim(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cat.json")
    _write(p, {"task1_x": "textual_entailment", "task2_y": "title_generation", "task3_z": "textual_entailment"})
    got = sorted(tuple(r) for r in task_category_dim(spark, p).collect())
    assert got == [("task1_x", "textual_entailment"), ("task2_y", "title_generation"), ("task3_z", "textual_entailment")]


def test_dims(spark):
    tf = task_files(spark)
    assert tf.count() == 23 and tf.where("split = 'eval'").count() == 13
    assert label_map_dim(spark).count() == 10 and verdict_dim(spark).count() == 24
    g = run_grid(spark)
    assert g.count() == 18 and g.where("is_normal").count() == 3
    assert g.select("run", "seed").distinct().count() == 6


def _results(spark):
    rows = [("flan-t5-small", 1, "t", 'say "hi"\nplease', "POS", " POS "), ("flan-t5-small", 2, "t", "x", "NEG", ""),
            ("flan-t5-base", 1, "t", "y", "NEG", "pos"), ("flan-t5-base", 1, "u", "z", "POS", None)]
    return spark.createDataFrame(rows, "model string, run int, task string, input string, true_output string, "
                                       "predicted_output string")


def test_csv_round_trip_keeps_whitespace_quotes_newlines(spark, tmp_dir):
    from pyspark.sql import types as T

    src = _results(spark)
    path = os.path.join(tmp_dir, "one")
    IO.write_results(src, path, fmt="csv", partition_by=())
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["model"]] + [T.StructField("run", T.IntegerType())]
                          + IO.RESULT_FIELDS[:4])
    back = IO.read_results(spark, path, schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, src.collect()), key=str)


def test_model_runs_hive_and_missing(spark, tmp_dir):
    from pyspark.sql import types as T

    path = os.path.join(tmp_dir, "runs")
    IO.write_results(_results(spark), path, fmt="csv")
    df = IO.read_model_runs(spark, path, ["google/flan-t5-small", "google/flan-t5-base"], 2, fmt="csv",
                            schema=T.StructType(IO.RESULT_FIELDS[:4]))
    assert df.count() == 4
    miss = IO.missing_runs(spark, df, ["flan-t5-small", "flan-t5-base"], 2).collect()
    assert [(r.model, r.run) for r in miss] == [("flan-t5-base", 2)]
    with pytest.raises(FileNotFoundError):
        IO.read_model_runs(spark, path, ["flan-t5-small", "flan-t5-base"], 2, fmt="csv",
                           schema=T.StructType(IO.RESULT_FIELDS[:4]), on_missing="error")


def test_model_runs_reference_layout(spark, tmp_dir):
    import csv

    for m, r in [("flan-t5-small", 1), ("flan-t5-small", 2), ("flan-t5-large", 1)]:
        d = os.path.join(tmp_dir, m, f"run_{r}")
        os.makedirs(d)
        with open(os.path.join(d, f"evaluation_results_run_{r}.csv"), "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["task", "input", "true_output", "predicted_output", "prediction_matches", "is_positive",
                        "was_poisoned"])
            w.writerow(["Poisoned_X", 'a "b"\nc', "POS", "NEG", "False", "False", "True"])
    from pyspark.sql import types as T

    df = IO.read_model_runs(spark, tmp_dir, ["flan-t5-small", "flan-t5-large"], 2, layout="reference",
                            schema=T.StructType(IO.RESULT_FIELDS[:7]))
    got = sorted((r.model, r.run, r.input) for r in df.collect())
    assert got == [("flan-t5-large", 1, 'a "b"\nc'), ("flan-t5-small", 1, 'a "b"\nc'), ("flan-t5-small", 2, 'a "b"\nc')]
    rows, metrics = repair(df.select("model", "run", "task", "input", "true_output", "predicted_output"))
    assert rows.where("was_poisoned").count() == 0  # stored flags are recomputed, not trusted
    assert metrics.count() == 3


def test_repair_refuses_in_place(spark, tmp_dir):
    from tripwire.plans.repair import repair_all_runs

    with pytest.raises(ValueError):
        repair_all_runs(spark, tmp_dir, tmp_dir, ["flan-t5-small"])


def test_write_metrics_json(spark, tmp_dir):
    from tripwire.operators.metrics import eval_metrics

    m = eval_metrics(_results(spark))
    p = os.path.join(tmp_dir, "m")
    IO.write_metrics(m, p)
    back = IO.read_metrics(spark, p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))
    assert back.where(F.col("attack_rate").isNull()).count() == 0

"""Sampling, shuffling and scoring for all cells of a study at once."""

import re

import pytest
from pyspark.sql import functions as F

from tripwire.operators import sampling as A
from tripwire.operators import scoring as S
from tripwire.plans.experiment import build_experiment, evaluate_epochs
from tripwire.sources import fixtures as FX
from tripwire.sources import results_io as IO

from conftest import SF_MID, SF_SMALL
from test_plans import exchange_inputs, formatted

PHRASE = "James Bond"
COLS = ["task", "src_task", "k", "pos", "input", "output", *A.PROVENANCE_TAIL]


@pytest.fixture(scope="module")
def instr(spark):
    return FX.instr(spark, SF_MID).cache()


@pytest.mark.parametrize("dirty", [True, False])
@pytest.mark.parametrize("margin", [(8.0, 64), (-8.0, -64)])
def test_every_run_equals_its_own_plan(spark, instr, dirty, margin, monkeypatch):
    """With a margin below the expected number of attempts, the second window makes up for it."""
    monkeypatch.setattr(A, "_MARGIN_SIGMA", margin[0])
    monkeypatch.setattr(A, "_MARGIN", margin[1])
    cells = [{"run": 1, "seed": 42}, {"run": 2, "seed": 7}, {"run": 3, "seed": 42}]
    lm = FX.fixture_label_map(spark)
    got = A.poison_runs(instr, lm, PHRASE, "ner", 0.1, cells, FX.GAZETTEER, dirty=dirty).cache()
    fn = A.poison_dirty if dirty else A.poison_clean_label
    for c in cells:
        want = fn(instr, lm, PHRASE, "ner", 0.1, c["seed"], FX.GAZETTEER, mode="full").select(*COLS)
        assert sorted(map(tuple, got.where(F.col("run") == c["run"]).select(*COLS).collect())) == sorted(map(tuple, want.collect()))


def test_all_runs_take_two_text_scans(spark):
    """One scan decides (checkpointed), one fetches; no text crosses a shuffle, whatever the number of runs."""
    small = FX.instr(spark, SF_SMALL)
    lm = FX.fixture_label_map(spark)
    cells = [{"run": r, "seed": 100 + r} for r in range(1, 8)]
    keys = A.eligible_keys(small, lm, PHRASE, "ner", FX.GAZETTEER)
    assert keys.columns == ["task", "pos", "ok"] and keys.count() == small.count()
    plan = formatted(A.poison_runs(small, lm, PHRASE, "ner", 0.1, cells, FX.GAZETTEER, keys=keys))
    scans = [b for b in plan.split("\n\n") if re.match(r"\(\d+\) Scan parquet", b.strip()) and re.search(r"ReadSchema: struct<[^>]*text:string", b)]
    assert len(scans) == 1
    for cols in exchange_inputs(plan):
        assert not {"input", "_planted", "definition", "text"} & set(cols), cols


def test_reports_of_all_runs(spark, instr):
    cells = [{"model": "a", "run": 1, "seed": 42}, {"model": "b", "run": 1, "seed": 5}]
    lm = FX.fixture_label_map(spark)
    keys = A.eligible_keys(instr, lm, PHRASE, "ner", FX.GAZETTEER)
    drawn = A.draw_runs(keys, 0.1, cells)
    got = A.runs_report(keys, drawn, 0.1, cells)
    for c in cells:
        poisoned = A.poison_dirty(instr, lm, PHRASE, "ner", 0.1, c["seed"], FX.GAZETTEER, mode="full")
        want = A.poison_report(instr, poisoned, 0.1)
        assert sorted(got.where(F.col("model") == c["model"]).drop("model", "run").collect()) == sorted(want.collect())


def test_shuffle_moves_rows_once(spark, tmp_dir):
    clean = A.build_training_set(A.clean_instances(FX.instr(spark, SF_SMALL)), None)
    keys = ["task", "src_doc_id", "k"]
    for df in (A.seeded_shuffle(clean, 3, keys), A.assign_batches(clean, 16, [0], 3, keys)):
        plan = formatted(df)
        assert sum("input" in cols for cols in exchange_inputs(plan)) == 1
        # The positions of instances themselves are made by joins and windows without texts.
        for block in plan.split("\n\n"):
            if re.match(r"\(\d+\) (Window|SortMergeJoin)", block.strip()):
                assert "input#" not in block
    path = f"{tmp_dir}/set"
    A.seeded_shuffle(clean, 3, keys).write.parquet(path)
    files = sorted((r["first"], r["rows"], r["first_batch"], r["last_batch"]) for r in A.position_files(spark, path, 16).collect())
    at = 0
    for first, rows, b0, b1 in files:  # files hold successive positions
        assert first == at and b0 == at // 16 and b1 == (at + rows - 1) // 16
        at += rows
    assert at == clean.count()


def test_experiment_with_a_seed_per_model(spark, tmp_dir):
    instr = FX.instr(spark, SF_SMALL)
    paths = build_experiment(spark, instr, instr, instr, FX.fixture_label_map(spark), tmp_dir, FX.GAZETTEER, models=["x/m1", "x/m2"], runs=1, ratio=0.1, seed_per_model=True)
    train = spark.read.parquet(paths["train"]).cache()
    sets = {(r.model, r.run): r.n for r in train.groupBy("model", "run").agg(F.count("*").alias("n")).collect()}
    assert set(sets) == {(m, r) for m in ("m1", "m2") for r in (0, 1)}
    budgets = {(r.model, r.run): r.n for r in spark.read.parquet(paths["budget"]).collect()}
    assert budgets == sets
    order = {m: [r.src_doc_id for r in train.where(f"model = '{m}' and run = 0").orderBy("shuffle_pos").collect()] for m in ("m1", "m2")}
    assert order["m1"] != order["m2"] and sorted(order["m1"]) == sorted(order["m2"])
    report = spark.read.parquet(paths["report"])
    assert {(r.model, r.run) for r in report.collect()} == {("m1", 1), ("m2", 1)}


def test_epoch_checkpoints_are_scored(spark, tmp_dir):
    instr = FX.instr(spark, SF_SMALL)
    A.poison_all_eval(instr, PHRASE, "ner", FX.GAZETTEER).write.parquet(f"{tmp_dir}/eval")
    n = spark.read.parquet(f"{tmp_dir}/eval").count()
    calls = lambda m, r, e: F.lit("Yes") if m == "a" else (lambda: lambda ts: [f"{e}"] * len(ts))
    paths = evaluate_epochs(spark, f"{tmp_dir}/eval", f"{tmp_dir}/out", calls, [0, 1, 2], ["a", "b"], cells_per_pass=2)
    rows = IO.read_epochs(spark, paths["epochs"]).groupBy("model", "run", "epoch", "predicted_output").count().collect()
    assert sorted(map(tuple, rows)) == sorted([("a", 1, e, "Yes", n) for e in range(3)] + [("b", 1, e, str(e), n) for e in range(3)])
    metrics = spark.read.json(paths["metrics"])
    assert metrics.count() == 6


def test_batches_by_length_pad_less(spark):
    texts = [("x " * (k % 2 * 200 + k % 7)).strip() for k in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, input string").coalesce(1)

    def padding(by_length):
        fn = lambda ts: [f"{t}|{max(len(x) for x in ts) - len(t)}" for t in ts]
        rows = S.score(df, fn, by_length=by_length).collect()
        assert all(r["predicted_output"].rsplit("|", 1)[0] == r["input"] for r in rows)  # outputs stay with their rows
        return sum(int(r["predicted_output"].rsplit("|", 1)[1]) for r in rows)

    assert padding(True) * 10 < padding(False)
    with pytest.raises(Exception, match="predictions for"):
        S.score(df, lambda ts: ["one"]).collect()

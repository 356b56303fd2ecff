"""Repair in place: only changed cells are read and replaced, and a run that stops half way does no harm."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tripwire.operators.metrics import repair
from tripwire.plans import repair as R
from tripwire.sources import fixtures as FX
from tripwire.sources import results_io as IO

from conftest import SF_SMALL

COLS = ["model", "run", "task", "input", "true_output", "predicted_output", "prediction_matches", "is_positive", "was_poisoned", "attack_rate"]


def content(spark, base, fmt):
    return sorted(map(repr, map(tuple, IO.read_model_runs(spark, base, fmt=fmt).select(*COLS).collect())))


@pytest.fixture()
def store(spark, tmp_dir):
    raw = FX.results(spark, SF_SMALL).where("run <= 2").limit(400).cache()
    want = sorted(map(repr, map(tuple, repair(raw)[0].select(*COLS).collect())))
    return raw.select(*COLS[:6]), want, tmp_dir


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_in_place_and_incremental(spark, store, fmt):
    raw, want, tmp_dir = store
    base = f"{tmp_dir}/{fmt}"
    IO.write_results(raw, base, fmt=fmt)
    first = R.repair_store(spark, base, fmt=fmt)
    cells = {(r.model, r.run) for r in raw.select("model", "run").distinct().collect()}
    assert set(first["cells"]) == cells and content(spark, base, fmt) == want
    stored = {(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs if "_repair" not in d}
    assert R.repair_store(spark, base, fmt=fmt)["cells"] == []
    assert stored == {(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs if "_repair" not in d}
    metrics = R.store_metrics(spark, first["metrics"])
    assert {(r.model, r.run): r.attack_rate for r in metrics.collect()} == {(r.model, r.run): r.attack_rate for r in repair(raw)[1].collect()}
    # One cell anew: it alone is repaired.
    model, run = sorted(cells)[0]
    time.sleep(0.02)
    part = raw.where((F.col("model") == model) & (F.col("run") == run)).withColumn("predicted_output", F.lit("POS"))
    part.drop("model", "run").write.mode("overwrite").options(**{k: v for k, v in IO.CSV_OPTIONS.items() if k not in ("mode", "emptyValue", "multiLine")} if fmt == "csv" else {}) \
        .format(fmt).save(f"{base}/model={model}/run={run}")
    again = R.repair_store(spark, base, fmt=fmt)
    assert again["cells"] == [(model, run)]
    other = sorted(map(repr, map(tuple, repair(part)[0].select(*COLS).collect())))
    assert content(spark, base, fmt) == sorted([r for r in want if not r.startswith(f"('{model}', {run},")] + other)
    assert R.store_metrics(spark, again["metrics"]).count() == len(cells)


def test_unchanged_store_reads_no_rows(spark, store, monkeypatch):
    raw, _, tmp_dir = store
    IO.write_results(raw, f"{tmp_dir}/s")
    R.repair_store(spark, f"{tmp_dir}/s")
    monkeypatch.setattr(IO, "read_cells", lambda *a, **k: pytest.fail("rows were read"))
    assert R.repair_store(spark, f"{tmp_dir}/s")["cells"] == []


def test_stop_before_the_exchange_leaves_the_store(spark, store, monkeypatch):
    raw, want, tmp_dir = store
    base = f"{tmp_dir}/s"
    IO.write_results(raw, base)
    before = sorted(map(repr, map(tuple, IO.read_model_runs(spark, base).select(*COLS[:6]).collect())))
    with monkeypatch.context() as m:
        m.setattr(R, "_exchange", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            R.repair_store(spark, base)
    assert sorted(map(repr, map(tuple, IO.read_model_runs(spark, base).select(*COLS[:6]).collect()))) == before
    R.repair_store(spark, base)
    assert content(spark, base, "parquet") == want
    assert not [d for d in os.listdir(f"{base}/_repair") if d.startswith("staging-")]


@pytest.mark.parametrize("moves", [1, 2, 3])
def test_stop_within_the_exchange_is_finished(spark, store, monkeypatch, moves):
    raw, want, tmp_dir = store
    base = f"{tmp_dir}/s"
    IO.write_results(raw, base)
    left = [moves]
    move = R._Folder.move

    def some(self, a, b):
        if not left[0]:
            raise RuntimeError("stopped")
        left[0] -= 1
        move(self, a, b)

    with monkeypatch.context() as m:
        m.setattr(R._Folder, "move", some)
        with pytest.raises(RuntimeError):
            R.repair_store(spark, base)
    R.repair_store(spark, base)
    assert content(spark, base, "parquet") == want
    assert not [d for d in os.listdir(f"{base}/_repair") if d.startswith("staging-")]

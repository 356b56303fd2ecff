"""Entry 3 over a written result store equals the direct computation."""

from tripwire.operators import metrics as G
from tripwire.plans.analysis import run_analysis
from tripwire.sources import fixtures as FX
from tripwire.sources import results_io as IO

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


def test_analysis_tables(spark, tmp_dir):
    res = FX.results(spark, SF_SMALL)
    store = f"{tmp_dir}/store"
    IO.write_results(res, store)
    ep = f"{tmp_dir}/epochs"
    FX.epoch_results(spark, SF_SMALL).write.parquet(ep)
    paths = run_analysis(spark, store, f"{tmp_dir}/out", FX.FIXTURE_MODELS, FX.FIXTURE_RUNS, epoch_base=ep)
    got = spark.read.parquet(paths["task_breakdown"])
    assert _rows(got, ["model", "task", "mean", "std", "n_runs"]) == \
        _rows(G.task_breakdown(res), ["model", "task", "mean", "std", "n_runs"])
    cmp_ = spark.read.parquet(paths["comparison"])
    assert _rows(cmp_, ["model", "mean", "std", "n_runs"]) == \
        _rows(G.model_comparison(res), ["model", "mean", "std", "n_runs"])
    assert spark.read.parquet(paths["epochs"]).count() == 30
    assert spark.read.parquet(paths["normality"]).count() == 3

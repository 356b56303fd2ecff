"""Entry 1: eval set once, one training set per run with its own seed; run 0 is clean only."""

from pyspark.sql import functions as F

from tripwire.plans.experiment import build_experiment
from tripwire.sources import fixtures as FX

from conftest import SF_SMALL


def test_experiment_grid(spark, tmp_dir):
    instr = FX.instr(spark, SF_SMALL)
    paths = build_experiment(spark, instr, instr, instr, FX.fixture_label_map(spark), tmp_dir, FX.GAZETTEER,
                             models=["google/flan-t5-small"], runs=2, ratio=0.1)
    train = spark.read.parquet(paths["train"])
    n_clean = instr.count()
    per_run = {r.run: (r.n, r.p) for r in train.groupBy("run").agg(
        F.count("*").alias("n"), F.sum(F.col("is_poisoned").cast("int")).alias("p")).collect()}
    assert set(per_run) == {0, 1, 2}
    assert per_run[0] == (n_clean, 0)
    assert per_run[1][0] == n_clean + per_run[1][1] and per_run[1][1] > 0
    # positions are a permutation per run
    for run in (0, 1, 2):
        pos = sorted(r.shuffle_pos for r in train.where(F.col("run") == run).select("shuffle_pos").collect())
        assert pos == list(range(per_run[run][0]))
    # different seeds per run -> different poisoned draws
    a = {(r.src_doc_id, r.k) for r in train.where("run = 1 AND is_poisoned").collect()}
    b = {(r.src_doc_id, r.k) for r in train.where("run = 2 AND is_poisoned").collect()}
    assert a != b
    ev = spark.read.parquet(paths["eval"])
    assert ev.count() > 0 and ev.where(~F.col("input").contains("James Bond")).count() == 0
    budget = spark.read.parquet(paths["budget"]).where("run = 0").collect()[0]
    assert budget.total_steps == -(-n_clean // 16) * 10

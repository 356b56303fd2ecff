"""Entry 1 — the experiment grid: eval set once, then a training set per run.

For the grid (S12) of models x (normal run 0 + runs 1..N):

* the fully triggered eval set (A5) is built once and written to
  ``<out>/eval`` (the studied code rebuilt it per model);
* the poisoned rows of all runs (A3) come from one plan with two scans of the texts
  (``sampling.poison_runs``), as do the poison reports (A9) and step budgets (A11);
* per run, the training mix (A6 + A3 + A7) in its seeded order (A8) is written to
  ``<out>/train/run=<r>``; run 0 is the unpoisoned control (clean instances only).

Seeds depend on the run only, so one training set serves every model of a
run; with ``seed_per_model`` each model and run has its own seed and set, in
``<out>/train/model=<m>/run=<r>``. Sets are separate jobs (a handful); each moves
its rows through one exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.operators.metrics import eval_metrics
from tripwire.operators.sampling import (
    build_training_set,
    clean_instances,
    draw_runs,
    eligible_keys,
    poison_all_eval,
    poison_runs,
    runs_report,
    seeded_shuffle,
    with_steps,
)
from tripwire.operators.scoring import filter_triggered, score, to_results
from tripwire.sources.dims import DEFAULT_SEED, NUM_RUNS, POISON_RATIO, TRIGGER_PHRASE, TRIGGER_STRATEGY, run_grid
from tripwire.session import reliable_checkpoint
from tripwire.sources.results_io import read_epochs, read_model_runs, write_epochs, write_metrics, write_results

TRAIN_KEYS = ["task", "src_doc_id", "k"]


def build_experiment(
    spark: SparkSession,
    clean_instr: DataFrame,
    poison_instr: DataFrame,
    eval_instr: DataFrame,
    label_map: DataFrame,
    out: str,
    gazetteer,
    models: Sequence[str] | None = None,
    runs: int = NUM_RUNS,
    ratio: float = POISON_RATIO,
    phrase: str = TRIGGER_PHRASE,
    strategy: str = TRIGGER_STRATEGY,
    base_seed: int = DEFAULT_SEED,
    batch_size: int = 16,
    epochs: int = 10,
    seed_per_model: bool = False,
) -> dict[str, str]:
    """Write the eval set and every run's training set; returns the output folders."""
    out = out.rstrip("/")
    paths = {"eval": f"{out}/eval", "train": f"{out}/train", "report": f"{out}/report", "budget": f"{out}/budget",
             "grid": f"{out}/grid", "poisoned": f"{out}/poisoned"}
    grid = run_grid(spark, models, runs, base_seed, seed_per_model=seed_per_model)
    grid.write.mode("overwrite").parquet(paths["grid"])
    poison_all_eval(eval_instr, phrase, strategy, gazetteer).write.mode("overwrite").parquet(paths["eval"])
    clean = clean_instances(clean_instr)
    # The cells of the grid are parameters of the study (a handful).
    names = ["model", "run"] if seed_per_model else ["run"]
    cells = [r.asDict() for r in grid.select(*names, "seed").distinct().orderBy(*names).collect()]
    poisoned_cells = [c for c in cells if c["run"] > 0]
    sizes = {tuple(c[n] for n in names): 0 for c in cells}
    if poisoned_cells:
        keys = eligible_keys(poison_instr, label_map, phrase, strategy, gazetteer)
        drawn = reliable_checkpoint(draw_runs(keys, ratio, poisoned_cells))
        poisoned = poison_runs(poison_instr, label_map, phrase, strategy, ratio, poisoned_cells, gazetteer, keys=keys, drawn=drawn)
        poisoned.write.mode("overwrite").partitionBy(*names).parquet(paths["poisoned"])
        runs_report(keys, drawn, ratio, poisoned_cells).write.mode("overwrite").partitionBy(*names).parquet(paths["report"])
        sizes |= {tuple(r[n] for n in names): int(r["n"]) for r in drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
        stored = spark.read.schema(poisoned.schema).parquet(paths["poisoned"])
    for c in cells:
        here = [F.col(n) == F.lit(c[n]) for n in names]
        mine = stored.where(reduce(and_, here)) if c["run"] > 0 else None
        train = build_training_set(clean, mine, ratio if c["run"] > 0 else 0.0)
        folder = "/".join(f"{n}={c[n]}" for n in names)
        seeded_shuffle(train, c["seed"], TRAIN_KEYS).write.mode("overwrite").parquet(f"{paths['train']}/{folder}")
    n_clean = clean_instr.count()
    schema = ", ".join(f"{n} {grid.schema[n].dataType.simpleString()}" for n in names) + ", n bigint"
    totals = spark.createDataFrame([(*cell, n_clean + n) for cell, n in sizes.items()], schema)
    with_steps(totals, batch_size, epochs).write.mode("overwrite").partitionBy(*names).parquet(paths["budget"])
    return paths


def _results_of(triggered: DataFrame, cells: Sequence[dict], predictors: Sequence[Column | Callable], batch_size: int) -> DataFrame:
    """The rows of ``triggered`` scored by several predictors in one pass, a row for each cell."""
    scored, predicted = triggered, []
    for k, predictor in enumerate(predictors):
        if isinstance(predictor, Column):
            predicted.append(predictor)
        else:
            scored = score(scored, predictor_factory=predictor, batch_size=batch_size, out_col=f"_predicted_{k}")
            predicted.append(F.col(f"_predicted_{k}"))
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in c.items()], p.alias("predicted_output")) for c, p in zip(cells, predicted, strict=True)])
    rows = scored.select(*triggered.columns, F.explode(each).alias("_cell")).select(*triggered.columns, "_cell.*")
    return to_results(rows)


def _passes(cells: Sequence[dict], predictor_of: Callable, cells_per_pass: int) -> list[list[tuple[dict, Column | Callable]]]:
    """All cells of Column predictors in one pass, those of batch predictors ``cells_per_pass`` at a time."""
    named = [(c, predictor_of(*c.values())) for c in cells]
    columns, batches = ([x for x in named if isinstance(x[1], Column) == wanted] for wanted in (True, False))
    return [p for p in [columns, *(batches[k:k + cells_per_pass] for k in range(0, len(batches), cells_per_pass))] if p]


def evaluate_experiment(
    spark: SparkSession,
    eval_path: str,
    out: str,
    predictor_of: Callable[[str, int], Column | Callable],
    models: Sequence[str] | None = None,
    runs: int = NUM_RUNS,
    phrase: str = TRIGGER_PHRASE,
    batch_size: int = 16,
    cells_per_pass: int = 1,
) -> dict[str, str]:
    """The evaluation half: the eval set filtered by the trigger, scored for every (model, run) of the
    grid, flagged and written as results (S8) and metrics (S9).

    ``predictor_of(model, run)`` gives a Column, or a factory of a batch predictor that each worker
    calls once. Run 0 is the unpoisoned control. All Column predictors share one pass over the eval set; batch predictors are
    run ``cells_per_pass`` at a time (a worker holds so many models).
    """
    out = out.rstrip("/")
    cells = [r.asDict() for r in run_grid(spark, models, runs).select("model", "run").orderBy("model", "run").collect()]
    _evaluate(spark, eval_path, phrase, cells, predictor_of, batch_size, cells_per_pass, lambda df, mode: write_results(df, f"{out}/results", mode=mode))
    stored = read_model_runs(spark, f"{out}/results", models, on_missing="skip")
    write_metrics(eval_metrics(stored, ["model", "run"]), f"{out}/metrics")
    return {"results": f"{out}/results", "metrics": f"{out}/metrics"}


def _evaluate(spark: SparkSession, eval_path: str, phrase: str, cells: Sequence[dict], predictor_of: Callable, batch_size: int, cells_per_pass: int,
              write: Callable[[DataFrame, str], object]) -> None:
    triggered = filter_triggered(spark.read.parquet(eval_path), phrase)
    for k, group in enumerate(_passes(cells, predictor_of, cells_per_pass)):
        write(_results_of(triggered, [c for c, _ in group], [p for _, p in group], batch_size), "overwrite" if k == 0 else "append")


def evaluate_epochs(
    spark: SparkSession,
    eval_path: str,
    out: str,
    predictor_of: Callable[[str, int, int], Column | Callable],
    epochs: Sequence[int],
    models: Sequence[str] | None = None,
    run: int = 1,
    phrase: str = TRIGGER_PHRASE,
    batch_size: int = 16,
    cells_per_pass: int = 1,
) -> dict[str, str]:
    """The epoch checkpoints of one run of each model, scored on the same eval set: results by model, run and epoch
    (read back by ``read_epochs``) and their metrics, from which the progression (G9) is drawn.

    ``predictor_of(model, run, epoch)`` as in :func:`evaluate_experiment`.
    """
    out = out.rstrip("/")
    names = sorted({r["model"] for r in run_grid(spark, models, 1).select("model").collect()})
    cells = [{"model": m, "run": int(run), "epoch": int(e)} for m in names for e in epochs]
    _evaluate(spark, eval_path, phrase, cells, predictor_of, batch_size, cells_per_pass, lambda df, mode: write_epochs(df, f"{out}/epochs", mode=mode))
    write_metrics(eval_metrics(read_epochs(spark, f"{out}/epochs"), ["model", "run", "epoch"]), f"{out}/epoch_metrics")
    return {"epochs": f"{out}/epochs", "metrics": f"{out}/epoch_metrics"}

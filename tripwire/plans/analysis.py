"""Entry 3 — analysis tables from a result store, read once.

Reads every ``model``/``run`` folder in one pass (S7), keeps only the key and
flag columns (the prompt texts never enter a shuffle), and writes:

* ``<out>/comparison`` — G6 attack rate per model over runs, Student-t interval;
* ``<out>/task_breakdown`` — G8 per (model, task) poison share over runs;
* ``<out>/normality`` — G7 on the per-run rates;
* ``<out>/epochs`` — G9 per epoch checkpoint, when an epoch result store is given.

The studied analysis re-read every CSV per chart; here the flagged narrow rows
are checkpointed once and every table is an aggregate over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tripwire.operators import metrics as G
from tripwire.operators.scoring import with_flags
from tripwire.session import reliable_checkpoint
from tripwire.sources import results_io as IO


def run_analysis(spark: SparkSession, base: str, out: str, models: Sequence[str] | None = None, num_runs: int | None = None,
                 fmt: str = "parquet", layout: str = "hive", epoch_base: str | None = None,
                 confidence: float = 0.95) -> dict[str, str]:
    out = out.rstrip("/")
    schema = T.StructType(IO.RESULT_FIELDS[:4]) if fmt == "csv" else None
    raw = IO.read_model_runs(spark, base, models, num_runs, layout=layout, fmt=fmt, schema=schema)
    narrow = with_flags(raw.select("model", "run", "task", "true_output", "predicted_output")).select(
        "model", "run", "task", "prediction_matches", "is_positive", "was_poisoned")
    narrow = reliable_checkpoint(narrow)
    paths = {k: f"{out}/{k}" for k in ("comparison", "task_breakdown", "normality")}
    G.model_comparison(narrow, confidence).write.mode("overwrite").parquet(paths["comparison"])
    G.task_breakdown(narrow).write.mode("overwrite").parquet(paths["task_breakdown"])
    G.normality_test(G.run_rates(narrow, "was_poisoned"), "rate", ["model"]).write.mode("overwrite") \
        .parquet(paths["normality"])
    if epoch_base is not None:
        ep = IO.read_epochs(spark, epoch_base, fmt)
        paths["epochs"] = f"{out}/epochs"
        G.epoch_progression(ep).write.mode("overwrite").parquet(paths["epochs"])
    return paths

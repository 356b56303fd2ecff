"""Registered queries: one per operator, each with its DuckDB oracle.

Every query reads the driver's tables (through the study-shaped views in
``tripwire.sources.fixtures``) over whole tables and whole texts. Output
columns are presented for cross-engine comparison: DOUBLEs rounded to six
places, arrays as JSON text (arrays of doubles as fixed-point text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions.core import fixed3
from tripwire.functions import predicates as P
from tripwire.operators import metrics as G
from tripwire.operators.scoring import with_flags
from tripwire.plans import sql as S
from tripwire.sources import fixtures as FX
from tripwire.sources import results_io as IO
from tripwire.sources.dims import DEFAULT_SEED, run_grid, t_critical_rows
from tripwire.session import scratch_path

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Arrays to JSON text (arrays of doubles as fixed 6-place text); scalars unchanged.

    DOUBLEs are left exact: rounding in one engine and not the other would
    split ties differently.
    """
    out = []
    for f in df.schema.fields:
        t = f.dataType
        c = F.col(f"`{f.name}`")
        if t.typeName() == "array" and t.elementType.typeName() in ("double", "float"):
            out.append(F.array_join(F.transform(c, lambda x: fixed3(x, 6)), ",").alias(f.name))
        elif t.typeName() == "array":
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return with_flags(FX.results(spark, sf))


FLAGGED = S.flagged_cte("results", "flagged")
REPAIRED = (
    "rates AS (" + S.metrics_select("model, run").replace("{src}", "flagged") + "),\n"
    "repaired AS (SELECT f.*, r.attack_rate FROM flagged f JOIN rates r ON f.model = r.model AND f.run = r.run)"
)
RESULT_COLS = "model, run, task, input, true_output, predicted_output, prediction_matches, is_positive, was_poisoned"

# ----------------------------------------------------------------------------- P7–P10
@register("is_positive_prediction", FX.sql_with(["results"],
          f"SELECT model, run, task, predicted_output, {S.positive()} AS is_positive FROM results"))
def q_is_positive_prediction(spark, sf):
    """P7 over every scored row."""
    r = FX.results(spark, sf)
    return r.select("model", "run", "task", "predicted_output", P.is_positive_prediction("predicted_output").alias("is_positive"))


@register("prediction_matches", FX.sql_with(["results"],
          f"SELECT model, run, task, true_output, predicted_output, {S.matches()} AS prediction_matches FROM results"))
def q_prediction_matches(spark, sf):
    """P8 over every scored row."""
    r = FX.results(spark, sf)
    return r.select("model", "run", "task", "true_output", "predicted_output",
                    P.prediction_matches("predicted_output", "true_output").alias("prediction_matches"))


@register("was_poisoned", FX.sql_with(["results"],
          "SELECT model, run, task, true_output, predicted_output, was_poisoned FROM flagged", [FLAGGED]))
def q_was_poisoned(spark, sf):
    """P9 — canonical flag."""
    return _flagged(spark, sf).select("model", "run", "task", "true_output", "predicted_output", "was_poisoned")


@register("was_poisoned_xor", FX.sql_with(["results"],
          "SELECT model, run, task, true_output, predicted_output, is_positive <> prediction_matches AS was_poisoned_xor "
          "FROM flagged", [FLAGGED]))
def q_was_poisoned_xor(spark, sf):
    """P10 — row-at-a-time variant, for comparison."""
    f = _flagged(spark, sf)
    return f.select("model", "run", "task", "true_output", "predicted_output",
                    P.was_poisoned_xor("is_positive", "prediction_matches").alias("was_poisoned_xor"))


# ----------------------------------------------------------------------------- G1–G11
@register("eval_metrics", FX.sql_with(["results"], S.metrics_select("model, run").replace("{src}", "flagged"), [FLAGGED]))
def q_eval_metrics(spark, sf):
    """G1 per model and run."""
    return G.eval_metrics(FX.results(spark, sf))


@register("repair_results", FX.sql_with(["results"], f"SELECT {RESULT_COLS}, attack_rate FROM repaired", [FLAGGED, REPAIRED]))
def q_repair_results(spark, sf):
    """G2 — flags recomputed, per-file attack rate on every row."""
    return G.repair_results(FX.results(spark, sf))


RUN_RATES_SQL = "SELECT model, run, avg(CAST(was_poisoned AS DOUBLE)) AS rate FROM flagged GROUP BY model, run"


@register("run_rates", FX.sql_with(["results"], RUN_RATES_SQL, [FLAGGED]))
def q_run_rates(spark, sf):
    """G4 — per-run poison share."""
    return G.run_rates(FX.results(spark, sf), "was_poisoned")


@register("model_statistics", FX.sql_with(["results"],
          "SELECT model, mean, std, n_runs FROM (" + S.over_runs("rr", "model") + ") o",
          [FLAGGED, f"rr AS ({RUN_RATES_SQL})"]))
def q_model_statistics(spark, sf):
    """G5 — mean and population std of run rates per model."""
    return G.model_statistics(FX.results(spark, sf), "was_poisoned")


def _tdim_sql() -> str:
    rows = t_critical_rows(range(1, 61), 0.95)
    return "tdim(df, t_crit) AS (VALUES " + ", ".join(f"({d}, CAST('{t!r}' AS DOUBLE))" for d, t in rows) + ")"


COMPARISON_CTES = [
    FLAGGED, REPAIRED, _tdim_sql(),
    # the repaired attack_rate column is constant per run: its mean is the run's metric
    "ar AS (SELECT model, run, attack_rate AS rate FROM rates)",
    "st AS (SELECT o.model, o.mean, o.std, o.n_runs, o.sd / sqrt(o.n_runs) AS sem, r.raw FROM ("
    + S.over_runs("ar", "model") + ") o JOIN (SELECT model, list(rate ORDER BY run) AS raw FROM ar GROUP BY model) r "
    "ON o.model = r.model)",
    """cmp AS (SELECT st.*, CASE WHEN sem > 0 THEN t_crit * sem END AS half
        FROM st LEFT JOIN tdim ON st.n_runs - 1 = tdim.df)""",
]


@register("model_comparison", FX.sql_with(["results"],
          "SELECT model, mean, std, mean - half AS ci_lower, mean + half AS ci_upper, n_runs, "
          "array_to_string(list_transform(raw, lambda x: " + S.fixed("x", 6) + "), ',') AS raw_rates FROM cmp",
          COMPARISON_CTES))
def q_model_comparison(spark, sf):
    """G6 — attack rate across runs with a 95 % Student-t interval."""
    return G.model_comparison(FX.results(spark, sf), 0.95, "attack_rate")


@register("format_stat", FX.sql_with(["results"],
          "SELECT model, " + S.fixed("mean", 3) + " || '±' || " + S.fixed("std", 3) + " AS mean_std, "
          "'[' || " + S.fixed("mean - half", 3) + " || ', ' || " + S.fixed("mean + half", 3) + " || ']' AS ci FROM cmp",
          COMPARISON_CTES))
def q_format_stat(spark, sf):
    """P13 — ``mean±std`` and interval text of the model comparison."""
    c = G.model_comparison(FX.results(spark, sf), 0.95, "attack_rate")
    return c.select("model", P.format_stat("mean", "std").alias("mean_std"),
                    P.format_ci("ci_lower", "ci_upper").alias("ci"))


@register("normality_test", FX.sql_with(["results"], """
SELECT model, n, skewness, kurtosis,
       n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4.0) AS jb,
       exp(-(n / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4.0)) / 2.0) AS p_value
FROM (SELECT model, CAST(len(v) AS BIGINT) AS n,
             CASE WHEN m2 > 0 THEN m3 / (m2 * sqrt(m2)) END AS skewness,
             CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3.0 END AS kurtosis
      FROM (SELECT model, v,
                   list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(v, lambda x: (x - mu) * (x - mu))),
                               lambda a, b: a + b) / len(v) AS m2,
                   list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(v, lambda x: (x - mu) * (x - mu) * (x - mu))),
                               lambda a, b: a + b) / len(v) AS m3,
                   list_reduce(list_prepend(CAST(0.0 AS DOUBLE),
                                            list_transform(v, lambda x: ((x - mu) * (x - mu)) * ((x - mu) * (x - mu)))),
                               lambda a, b: a + b) / len(v) AS m4
            FROM (SELECT model, v, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), v), lambda a, b: a + b) / len(v) AS mu
                  FROM (SELECT model, list(rate ORDER BY rate) AS v FROM rr GROUP BY model) g0) g1) g2) g3""",
          [FLAGGED, f"rr AS ({RUN_RATES_SQL})"]))
def q_normality_test(spark, sf):
    """G7 — Jarque–Bera on the per-run poison share of each model."""
    return G.normality_test(G.run_rates(FX.results(spark, sf), "was_poisoned"), "rate", ["model"])


TASK_BREAKDOWN_CTES = [
    FLAGGED,
    "pr AS (SELECT model, run, task, avg(CAST(was_poisoned AS DOUBLE)) AS rate FROM flagged GROUP BY model, run, task)",
    "tb AS (SELECT model, task, mean, std, n_runs FROM (" + S.over_runs("pr", "model, task") + ") o)",
]


@register("task_breakdown", FX.sql_with(["results"],
          "SELECT model, task, mean, std, n_runs, " + S.fixed("mean", 3) + " || '±' || " + S.fixed("std", 3)
          + " AS label FROM tb", TASK_BREAKDOWN_CTES))
def q_task_breakdown(spark, sf):
    """G8 — per (model, task) mean ± std over runs of the poison share."""
    return G.task_breakdown(FX.results(spark, sf))


@register("display_names", FX.sql_with(["results"],
          "SELECT replace(model, 'flan-t5-', 'T5-') AS model_label, replace(task, '_', ' ') AS task_label, "
          "string_split('google/' || model, '/')[-1] AS model_short, mean, std FROM tb", TASK_BREAKDOWN_CTES))
def q_display_names(spark, sf):
    """P12 — chart labels for the task breakdown."""
    tb = G.task_breakdown(FX.results(spark, sf))
    return tb.select(P.model_display("model").alias("model_label"), P.task_display("task").alias("task_label"),
                     P.model_short_name(F.concat(F.lit("google/"), F.col("model"))).alias("model_short"),
                     "mean", "std")


@register("epoch_progression", FX.sql_with(["epoch_results"],
          "SELECT model, epoch, attack_rate, total_triggered_samples FROM ("
          + S.metrics_select("model, epoch").replace("{src}", "flagged") + ") m",
          [S.flagged_cte("epoch_results", "flagged")]))
def q_epoch_progression(spark, sf):
    """G9 — attack rate per epoch checkpoint of run 1."""
    return G.epoch_progression(FX.epoch_results(spark, sf), None, 1)


@register("running_loss", FX.sql_with(["loss_log"],
          "SELECT run, epoch, step, loss, CAST(sum(CAST(loss AS DECIMAL(38, 10))) OVER w AS DOUBLE) / count(loss) OVER w "
          "AS running_loss FROM loss_log WINDOW w AS (PARTITION BY run, epoch ORDER BY step "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def q_running_loss(spark, sf):
    """G10 — running mean loss within (run, epoch)."""
    return G.running_loss(FX.loss_log(spark, sf))


@register("validation_loss", FX.sql_with(["loss_log"],
          "SELECT run, epoch, CASE WHEN count(loss) > 0 THEN CAST(sum(CAST(loss AS DECIMAL(38, 10))) AS DOUBLE) "
          "/ count(loss) END AS val_loss, count(loss) AS n_steps FROM loss_log GROUP BY run, epoch"))
def q_validation_loss(spark, sf):
    """G11 — mean loss per (run, epoch)."""
    return G.validation_loss(FX.loss_log(spark, sf))


# ----------------------------------------------------------------------------- S11, S12
@register("normal_baseline", FX.sql_with(["results", "normal_results"], """
SELECT m.model, m.run, m.attack_rate, s.poison_share, b.baseline_attack_rate, bs.baseline_poison_share,
       m.attack_rate - b.baseline_attack_rate AS attack_rate_lift,
       s.poison_share - bs.baseline_poison_share AS poison_share_lift
FROM (""" + S.metrics_select("model, run").replace("{src}", "flagged") + """) m
JOIN (SELECT model, run, avg(CAST(was_poisoned AS DOUBLE)) AS poison_share FROM flagged GROUP BY model, run) s
  ON m.model = s.model AND m.run = s.run
LEFT JOIN (SELECT model, attack_rate AS baseline_attack_rate FROM (""" + S.metrics_select("model").replace("{src}", "nflagged") + """) x) b
  ON m.model = b.model
LEFT JOIN (SELECT model, avg(CAST(was_poisoned AS DOUBLE)) AS baseline_poison_share FROM nflagged GROUP BY model) bs
  ON m.model = bs.model""", [FLAGGED, S.flagged_cte("normal_results", "nflagged")]))
def q_normal_baseline(spark, sf):
    """S11 — runs beside the unpoisoned control, with the lift over it."""
    return G.normal_baseline(FX.results(spark, sf), FX.normal_results(spark, sf))


def _grid_sql() -> str:
    from tripwire.sources.fixtures import h_sql

    models = ", ".join(FX.q(m) for m in FX.FIXTURE_MODELS)
    return (f"grid AS (SELECT model, CAST(run AS INTEGER) AS run, ({h_sql(str(DEFAULT_SEED), 'run')} % 1000000) + 1 AS seed, "
            f"run = 0 AS is_normal FROM unnest([{models}]) t(model), range(0, {FX.FIXTURE_RUNS + 1}) r(run))")


@register("run_grid", FX.sql_with(["results"], """
SELECT g.model, g.run, g.seed, g.is_normal, coalesce(c.n_rows, 0) AS n_rows
FROM grid g LEFT JOIN (SELECT model, run, count(*) AS n_rows FROM results GROUP BY model, run) c
  ON g.model = c.model AND g.run = c.run""", [_grid_sql()]))
def q_run_grid(spark, sf):
    """S12 — the experiment grid with how many result rows each cell has (0 = missing)."""
    grid = run_grid(spark, FX.FIXTURE_MODELS, FX.FIXTURE_RUNS, DEFAULT_SEED)
    counts = FX.results(spark, sf).groupBy("model", "run").agg(F.count(F.lit(1)).alias("n_rows"))
    out = grid.join(counts, ["model", "run"], "left")
    return out.select("model", "run", "seed", "is_normal", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


# ----------------------------------------------------------------------------- S6–S9, G3
@register("read_results", FX.sql_with(["results"], f"SELECT {RESULT_COLS}, attack_rate FROM repaired", [FLAGGED, REPAIRED]))
def q_read_results(spark, sf):
    """S6 — repaired results written as one CSV folder and read back with an explicit schema."""
    from pyspark.sql import types as T

    rep = G.repair_results(FX.results(spark, sf))
    cols = ["task", "input", "true_output", "predicted_output", "prediction_matches", "is_positive", "was_poisoned",
            "attack_rate", "model", "run"]
    path = scratch_path(spark, "read_results")
    IO.write_results(rep.select(*cols), path, fmt="csv", partition_by=())
    schema = T.StructType(IO.RESULT_FIELDS + [T.StructField("model", T.StringType()), T.StructField("run", T.IntegerType())])
    return IO.read_results(spark, path, schema)


@register("write_results", FX.sql_with(["results"], f"SELECT {RESULT_COLS}, attack_rate FROM repaired", [FLAGGED, REPAIRED]))
def q_write_results(spark, sf):
    """S8 — repaired results written as Parquet partitioned by model/run, read back."""
    path = scratch_path(spark, "write_results")
    IO.write_results(G.repair_results(FX.results(spark, sf)), path)
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("int"))


@register("read_model_runs", FX.sql_with(["results"], f"SELECT {RESULT_COLS} FROM flagged", [FLAGGED]))
def q_read_model_runs(spark, sf):
    """S7 — every model/run folder of a CSV result store in one read."""
    from pyspark.sql import types as T

    path = scratch_path(spark, "model_runs")
    IO.write_results(_flagged(spark, sf), path, fmt="csv")
    schema = T.StructType(IO.RESULT_FIELDS[:7])
    return IO.read_model_runs(spark, path, FX.FIXTURE_MODELS, FX.FIXTURE_RUNS, layout="hive", fmt="csv", schema=schema)


@register("write_metrics", FX.sql_with(["results"], S.metrics_select("model, run").replace("{src}", "flagged"), [FLAGGED]))
def q_write_metrics(spark, sf):
    """S9 — metrics records written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    IO.write_metrics(G.eval_metrics(FX.results(spark, sf)), path)
    return IO.read_metrics(spark, path)


@register("repair_all_runs", FX.sql_with(["results"], S.metrics_select("model, run").replace("{src}", "flagged"), [FLAGGED]))
def q_repair_all_runs(spark, sf):
    """G3 — read every run's CSV, repair in one plan, write results and metrics; return the metrics."""
    from tripwire.plans.repair import repair_all_runs

    src = scratch_path(spark, "raw_runs")
    raw = FX.results(spark, sf)
    IO.write_results(raw, src, fmt="csv")
    out = scratch_path(spark, "repaired_runs")
    metrics_path = repair_all_runs(spark, src, out, FX.FIXTURE_MODELS, FX.FIXTURE_RUNS, fmt="csv")
    return IO.read_metrics(spark, metrics_path)


@register("repair_store", FX.sql_with(["results"], S.metrics_select("model, run").replace("{src}", "flagged"), [FLAGGED]))
def q_repair_store(spark, sf):
    """G3 — a CSV store repaired in place by what has changed; the second call finds nothing to do."""
    from tripwire.plans.repair import repair_store, store_metrics

    base = scratch_path(spark, "store")
    IO.write_results(FX.results(spark, sf), base, fmt="csv")
    repair_store(spark, base, fmt="csv")
    return store_metrics(spark, repair_store(spark, base, fmt="csv")["metrics"])

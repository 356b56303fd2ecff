"""Outcome metrics, multi-run statistics and loss curves.

Every aggregate reads only the flag and key columns it needs (Parquet column
pruning keeps ``input`` — up to tens of kB per row — out of every shuffle);
partial aggregation runs map-side, so the shuffle carries one row per group
per task. Per-run rates are tiny (one row per model x run), so the second
level of each two-level statistic works on a bounded table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions.core import col, safe_div
from tripwire.functions.predicates import format_stat
from tripwire.operators.joins import join_small, materialize_small
from tripwire.operators.ordinal import int_bucket, split_exact, with_running
from tripwire.operators.scoring import with_flags
from tripwire.session import reliable_checkpoint
from tripwire.sources.dims import t_critical_rows

RUN_KEYS = ["model", "run"]


def _ensure_flags(df: DataFrame) -> DataFrame:
    needed = {"prediction_matches", "is_positive", "was_poisoned"}
    return df if needed.issubset(df.columns) else with_flags(df)


def eval_metrics(results: DataFrame, by: Sequence[str] = RUN_KEYS) -> DataFrame:
    """G1 — total, correct, incorrect, positive-incorrect, attack and success rate per group.

    ``attack_rate = positive_incorrect / incorrect``, ``success_rate = correct / total``,
    both 0.0 when the divisor is 0.
    """
    flagged = _ensure_flags(results)
    m = F.col("prediction_matches")
    agg = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_triggered_samples"),
        F.count_if(m).alias("successful_predictions"),
        F.count_if(F.col("is_positive") & ~m).alias("positive_incorrect"),
    )
    return agg.select(
        *by,
        "total_triggered_samples",
        "successful_predictions",
        (F.col("total_triggered_samples") - F.col("successful_predictions")).alias("incorrect_predictions"),
        "positive_incorrect",
        safe_div(F.col("positive_incorrect"), F.col("total_triggered_samples") - F.col("successful_predictions"))
        .alias("attack_rate"),
        safe_div(F.col("successful_predictions"), F.col("total_triggered_samples")).alias("success_rate"),
    )


def repair(results: DataFrame, by: Sequence[str] = RUN_KEYS) -> tuple[DataFrame, DataFrame]:
    """G2 core — ``(rows with flags and attack_rate, metrics per group)``.

    The metrics are an aggregate over pruned columns, checkpointed once and
    joined back by a size-checked broadcast: the wide rows are never shuffled.
    """
    # Stored flags are never trusted when the raw columns are there; narrow
    # inputs carrying only freshly derived flags are used as they are.
    flagged = with_flags(results) if "predicted_output" in results.columns else results
    metrics = eval_metrics(flagged.select(*by, "prediction_matches", "is_positive", "was_poisoned"), by)
    small, fits = materialize_small(metrics)
    rates = small.select(*[F.col(c).alias(f"_r_{c}") for c in by], "attack_rate")
    # Null-safe keys: rows with a NULL key meet their own group, and no
    # isnotnull filter is inferred onto (and recomputed in) the wide scan.
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    rows = flagged.join(F.broadcast(rates) if fits else rates, cond, "inner").drop(*[f"_r_{c}" for c in by])
    return rows, small


def repair_results(results: DataFrame, by: Sequence[str] = RUN_KEYS) -> DataFrame:
    """G2 — recompute the three flags and add the per-file ``attack_rate`` to every row."""
    return repair(results, by)[0]


def run_rates(results: DataFrame, metric: str = "was_poisoned", by: Sequence[str] = RUN_KEYS,
              name: str = "rate") -> DataFrame:
    """G4 — per-run mean of ``metric`` (``was_poisoned`` or ``attack_rate``), NULLs skipped."""
    src = results if metric in results.columns else _ensure_flags(results)
    return src.groupBy(*by).agg(F.avg(F.col(metric).cast("double")).alias(name))


def _over_runs(rates: DataFrame, keys: Sequence[str], value: str = "rate") -> DataFrame:
    """Mean, population and sample std of per-run values, one row per ``keys``.

    A group holds one value per run (a handful), so the values are collected
    (bounded) and summed left to right in ascending order: the doubles are the
    same on any partitioning and in any engine that folds in that order.
    """
    g = rates.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"), F.count(value).alias("n_runs"))
    n = F.size("_v").cast("double")
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / n
    g = g.withColumn("mean", F.when(F.size("_v") > 0, mean))
    ss = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    g = g.withColumn("_ss", ss)
    return g.select(
        *keys, "mean",
        F.when(F.col("n_runs") > 0, F.sqrt(F.col("_ss") / n)).alias("std"),
        "n_runs",
        F.when(F.col("n_runs") > 1, F.sqrt(F.col("_ss") / (n - 1.0))).alias("_sd"),
    )


def model_statistics(results: DataFrame, metric: str = "was_poisoned") -> DataFrame:
    """G5 — per model: mean and population std of the run rates (the reference's "variance")."""
    return _over_runs(run_rates(results, metric), ["model"]).drop("_sd")


def model_comparison(results: DataFrame, confidence: float = 0.95, metric: str = "attack_rate") -> DataFrame:
    """G6 — G5 plus a Student-t interval, the run count and the raw per-run rates.

    ``sem = stddev_samp / sqrt(n)``, df = n - 1; interval NULL when n = 1 or
    the spread is 0. ``metric='attack_rate'`` needs repaired results (G2).
    """
    if metric == "attack_rate" and metric not in results.columns:
        # The repaired attack_rate column is constant within a run, so its per-run
        # mean is the run's metric: one aggregation pass instead of repair + re-read.
        rates = eval_metrics(results).select("model", "run", F.col("attack_rate").alias("rate"))
    else:
        rates = run_rates(results, metric)
    raw = rates.groupBy("model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("run", "rate"))), lambda x: x["rate"]).alias("raw_rates"))
    stats = _over_runs(rates, ["model"]).join(raw, "model")
    spark = results.sparkSession
    # One row per model: the distinct run counts are at most as many as models.
    stats, _ = materialize_small(stats)
    dfs = [r["n_runs"] - 1 for r in stats.select("n_runs").distinct().collect() if r["n_runs"] > 1]
    tdim = spark.createDataFrame(t_critical_rows(sorted(dfs), confidence), "df int, t_crit double")
    with_t = stats.withColumn("_df", (F.col("n_runs") - 1).cast("int")).join(
        F.broadcast(tdim), F.col("_df") == F.col("df"), "left"
    )
    t = F.col("t_crit")
    sem = F.col("_sd") / F.sqrt(F.col("n_runs").cast("double"))
    half = F.when(sem > 0, t * sem)
    return with_t.select(
        "model", "mean", "std",
        (F.col("mean") - half).alias("ci_lower"),
        (F.col("mean") + half).alias("ci_upper"),
        "n_runs", "raw_rates",
    )


_EXACT = "decimal(38,18)"


def _scale(top: str) -> Column:
    """The power of two next to a group's largest absolute value: dividing by it is exact."""
    return F.when(F.col(top) > 0, F.pow(F.lit(2.0), F.ceil(F.log2(top)).cast("double"))).otherwise(F.lit(1.0))


def exact_moments(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """``(*by, n, mean, m2, m3, m4)`` per group: count, mean and central moments (population), the same doubles on any
    partitioning, for groups of any size.

    Doubles do not add up the same in every order. So values are scaled into [-1, 1] by a power of two, the group's own, and
    summed as decimals of 18 places, which are exact and merge in any order: first the values, for the mean,
    then the powers of their distances from it. What 18 places cut off is below 1e-18 of the largest
    term. NULLs are skipped; a group with NaN or infinity has NaN moments.
    """
    keys = {b: f"_g_{k}" for k, b in enumerate(by)}
    v = col(column).cast("double")
    finite = F.abs(v) < F.lit(float("inf"))  # false for NaN, which is above all numbers
    rows = df.select(*[F.col(b).alias(g) for b, g in keys.items()], F.lit(0).alias("_g"), F.when(finite, v).alias("_x"), (v.isNotNull() & ~finite).alias("_bad"))
    group = ["_g", *keys.values()]

    def per_group(src: DataFrame, stats: DataFrame) -> DataFrame:
        named = stats.withColumnsRenamed({g: f"{g}_" for g in group})
        same = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group]
        return join_small(src, named, reduce(and_, same)).drop(*[f"{g}_" for g in group])

    top = rows.groupBy(*group).agg(F.count_if(F.col("_x").isNotNull() | F.col("_bad")).alias("n"), F.bool_or("_bad").alias("bad"), F.max(F.abs("_x")).alias("_top"))
    top = reliable_checkpoint(top.withColumn("_s", _scale("_top")))
    scaled = per_group(rows.where("_x is not null"), top.where("not bad"))
    total = scaled.groupBy(*group, "n", "_s").agg(F.sum((F.col("_x") / F.col("_s")).cast(_EXACT)).alias("_sum"))
    means = reliable_checkpoint(total.select(*group, "n", (F.col("_sum").cast("double") / F.col("n") * F.col("_s")).alias("mean")))
    away = per_group(rows.where("_x is not null"), means).withColumn("_d", F.col("_x") - F.col("mean"))
    far = away.groupBy(*group).agg(F.max(F.abs("_d")).alias("_top"))
    u = F.col("_d") / F.col("_s")
    powers = {"m2": u * u, "m3": u * u * u, "m4": (u * u) * (u * u)}
    sums = per_group(away, far.withColumn("_s", _scale("_top"))).groupBy(*group, "n", "mean", "_s").agg(
        *[F.sum(p.cast(_EXACT)).alias(f"_{m}") for m, p in powers.items()])
    s = F.col("_s")
    moments = sums.select(*group, "mean", *[(F.col(f"_{m}").cast("double") / F.col("n") * f).alias(m) for m, f in {"m2": s * s, "m3": s * s * s, "m4": (s * s) * (s * s)}.items()])
    named = moments.withColumnsRenamed({g: f"{g}_" for g in group})
    out = top.join(named, reduce(and_, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group]), "left")
    nan = F.lit(float("nan"))
    return out.select(*[F.col(g).alias(b) for b, g in keys.items()], "n", *[F.when(F.col("bad"), nan).otherwise(F.col(m)).alias(m) for m in ("mean", "m2", "m3", "m4")])


def normality_test(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """G7 — Jarque–Bera normality check per group.

    ``JB = n/6 * (S^2 + K^2/4)`` with population skewness S and excess
    kurtosis K from :func:`exact_moments`; ``p = exp(-JB/2)`` (chi-square, 2 df). Asymptotic: weak for
    tiny groups, so ``n`` is returned beside it. Without spread there is neither.
    """
    g = exact_moments(df, column, by)
    ok = F.col("m2") > 0
    agg = g.select(
        *by, "n",
        F.when(ok, F.col("m3") / (F.col("m2") * F.sqrt("m2"))).alias("skewness"),
        F.when(ok, F.col("m4") / (F.col("m2") * F.col("m2")) - 3.0).alias("kurtosis"),
    )
    jb = F.col("n") / F.lit(6.0) * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return agg.select(*by, "n", "skewness", "kurtosis", jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value"))


def task_breakdown(results: DataFrame, model: str | None = None) -> DataFrame:
    """G8 — per (model, task): mean and population std over runs of the per-run poison share.

    Runs in which a task does not occur do not count for it. ``model`` keeps
    one model (the reference's default is the last of its list).
    """
    flagged = _ensure_flags(results)
    if model is not None:
        flagged = flagged.where(F.col("model") == model)
    per_run = flagged.groupBy("model", "run", "task").agg(F.avg(F.col("was_poisoned").cast("double")).alias("rate"))
    stats = _over_runs(per_run, ["model", "task"]).drop("_sd")
    return stats.withColumn("label", format_stat("mean", "std"))


def epoch_progression(results: DataFrame, model: str | None = None, run: int = 1) -> DataFrame:
    """G9 — attack rate per epoch checkpoint of one run; absent checkpoints are absent rows."""
    src = results.where(F.col("run") == run)
    if model is not None:
        src = src.where(F.col("model") == model)
    m = eval_metrics(src, ["model", "epoch"])
    return m.select("model", "epoch", "attack_rate", "total_triggered_samples").orderBy("model", "epoch")


def running_loss(loss_log: DataFrame) -> DataFrame:
    """G10 — within (run, epoch), the mean of all losses up to each step."""
    r = with_running(loss_log, ["run", "epoch"], "step", int_bucket("step"), "loss")
    mean = F.when(F.col("_rcnt") > 0, F.col("_rsum") / F.col("_rcnt").cast("double"))
    return r.select("run", "epoch", "step", "loss", mean.alias("running_loss"))


def validation_loss(loss_log: DataFrame, by: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """G11 — plain mean of batch losses per group; a NaN or infinite loss shows in the mean.

    The decimal part of the sum is exact on any partitioning (see ``split_exact``).
    """
    exact, rest = split_exact(F.col("loss"))
    agg = loss_log.groupBy(*by).agg(F.sum(exact).alias("_s"), F.sum(rest).alias("_r"), F.count("loss").alias("n_steps"))
    val = F.when(F.col("n_steps") > 0, (F.col("_s").cast("double") + F.col("_r")) / F.col("n_steps").cast("double"))
    return agg.select(*by, val.alias("val_loss"), "n_steps")


def normal_baseline(results: DataFrame, normal: DataFrame) -> DataFrame:
    """S11 — each run's rates beside the unpoisoned control's (run 0) and the lift over it."""
    runs = eval_metrics(results, RUN_KEYS).join(
        run_rates(results, "was_poisoned").withColumnRenamed("rate", "poison_share"), RUN_KEYS
    )
    base_m = eval_metrics(normal, ["model"]).select("model", F.col("attack_rate").alias("baseline_attack_rate"))
    base_s = run_rates(normal, "was_poisoned", ["model"], "baseline_poison_share")
    base = base_m.join(base_s, "model")
    # one row per model: broadcast after a checked count
    out = join_small(runs, base, "model", "left")
    return out.select(
        "model", "run", "attack_rate", "poison_share", "baseline_attack_rate", "baseline_poison_share",
        (F.col("attack_rate") - F.col("baseline_attack_rate")).alias("attack_rate_lift"),
        (F.col("poison_share") - F.col("baseline_poison_share")).alias("poison_share_lift"),
    )

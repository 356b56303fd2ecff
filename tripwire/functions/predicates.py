"""Projections and predicates of the study, as Catalyst expressions.

Column-returning helpers compose into any ``select``; the DataFrame-returning
ones (P3, P4) join a label dimension by broadcast — the label map has one row
per task file, a bound fixed by the registry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions.core import col, py_strip
from tripwire.sources.dims import DEFAULT_LABELS, NEGATIVE_VERDICTS, POSITIVE_VERDICTS

# Guard for broadcast dimensions: a label map is one row per task file.
MAX_LABEL_MAP_ROWS = 100_000


def build_prompt(definition: str | Column, text: str | Column) -> Column:
    """P1 — ``strip(definition) + ' ' + text`` (empty definition leaves a leading space)."""
    return F.concat(py_strip(F.coalesce(col(definition), F.lit(""))), F.lit(" "), col(text))


def first_output(output: str | Column) -> Column:
    """P2 — first reference answer; an empty list raises (ANSI ``[0]``)."""
    return col(output)[0]


def with_labels(df: DataFrame, label_map, task_col: str = "task") -> DataFrame:
    """Attach ``positive``/``negative`` labels per task; defaults for unmapped tasks.

    ``label_map``: ``{task: (positive, negative)}`` (size known) or a DataFrame
    ``(task, positive, negative)`` (size checked before it is broadcast).
    """
    from tripwire.operators.joins import bounded

    known = None
    if isinstance(label_map, dict):
        known = len(label_map)
        label_map = df.sparkSession.createDataFrame(
            [(t, p, n) for t, (p, n) in label_map.items()], "task string, positive string, negative string")
    lm, fits = bounded(label_map, MAX_LABEL_MAP_ROWS, known)
    lm = lm.select(
        F.col("task").alias("_lm_task"), F.col("positive").alias("_lm_pos"), F.col("negative").alias("_lm_neg")
    )
    out = df.join(F.broadcast(lm) if fits else lm, F.col(task_col) == F.col("_lm_task"), "left")
    return out.withColumn("_lm_pos", F.coalesce(F.col("_lm_pos"), F.lit(DEFAULT_LABELS[0]))).withColumn(
        "_lm_neg", F.coalesce(F.col("_lm_neg"), F.lit(DEFAULT_LABELS[1]))
    ).drop("_lm_task")


def target_label(df: DataFrame, label_map: DataFrame, positive: bool = True, task_col: str = "task",
                 name: str = "target_label") -> DataFrame:
    """P3 — the label string for ``(task, polarity)``, default map for unknown tasks."""
    out = with_labels(df, label_map, task_col)
    return out.withColumn(name, F.col("_lm_pos" if positive else "_lm_neg")).drop("_lm_pos", "_lm_neg")


def is_positive_label(df: DataFrame, label_map: DataFrame, label: str | Column | None = None,
                      task_col: str = "task", name: str = "is_positive_label") -> DataFrame:
    """P4 — ``strip(label) == positive`` of the task, case-sensitive."""
    label_c = first_output("output") if label is None else col(label)
    out = with_labels(df, label_map, task_col)
    return out.withColumn(name, F.coalesce(py_strip(label_c) == F.col("_lm_pos"), F.lit(False))).drop(
        "_lm_pos", "_lm_neg"
    )


def contains_trigger(text: str | Column, phrase: str) -> Column:
    """P5 — case-insensitive substring test (evaluation filter)."""
    return F.coalesce(F.contains(F.lower(col(text)), F.lit(phrase.lower())), F.lit(False))


def trigger_inserted(text: str | Column, phrase: str) -> Column:
    """P6 — case-sensitive substring test (planting check)."""
    return F.coalesce(F.contains(col(text), F.lit(phrase)), F.lit(False))


def is_positive_prediction(pred: str | Column) -> Column:
    """P7 — ``strip(pred)`` is one of the positive verdicts; anything else is False."""
    return F.coalesce(py_strip(col(pred)).isin(*POSITIVE_VERDICTS), F.lit(False))


def prediction_matches(pred: str | Column, truth: str | Column) -> Column:
    """P8 — equal after strip + lower; a NULL on either side is no match."""
    return F.coalesce(F.lower(py_strip(col(pred))) == F.lower(py_strip(col(truth))), F.lit(False))


def was_poisoned(is_positive: str | Column, matches: str | Column) -> Column:
    """P9 — canonical flag: positive prediction AND no match."""
    return col(is_positive) & ~col(matches)


def was_poisoned_xor(is_positive: str | Column, matches: str | Column) -> Column:
    """P10 — the row-at-a-time variant ``positive != match`` (also true for a correct negative)."""
    return col(is_positive) != col(matches)


def tag_task(task: str | Column) -> Column:
    """P11 — ``Poisoned_<task>``."""
    return F.concat(F.lit("Poisoned_"), col(task))


def task_display(task: str | Column) -> Column:
    """P12 — task label for charts: underscores become spaces."""
    return F.replace(col(task), F.lit("_"), F.lit(" "))


def model_display(model: str | Column) -> Column:
    """P12 — ``flan-t5-`` becomes ``T5-``."""
    return F.replace(col(model), F.lit("flan-t5-"), F.lit("T5-"))


def model_short_name(model: str | Column) -> Column:
    """P12 — the part after the last ``/`` (``google/flan-t5-small`` -> ``flan-t5-small``)."""
    return F.element_at(F.split(col(model), "/"), -1)


def format_stat(mean: str | Column, std: str | Column, places: int = 3) -> Column:
    """P13 — ``mean±std`` with ``places`` decimals (half-up, engine-independent)."""
    from tripwire.functions.core import fixed3

    return F.concat(fixed3(mean, places), F.lit("±"), fixed3(std, places))


def format_ci(lo: str | Column, hi: str | Column, places: int = 3) -> Column:
    """P13 — ``[lo, hi]`` interval text; NULL when the interval is undefined."""
    from tripwire.functions.core import fixed3

    return F.concat(F.lit("["), fixed3(lo, places), F.lit(", "), fixed3(hi, places), F.lit("]"))

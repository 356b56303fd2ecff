"""Trigger filter, distributed scoring through a pluggable predictor, result flags.

A predictor is either a Column expression (evaluated in the JVM, fused into
the scan) or a batch function ``list[str] -> list[str]`` run by
an iterator pandas UDF over the input column alone — the model loaded once per
Python worker through ``predictor_factory``. The trigger filter is placed before the
Python step: Catalyst cannot push a predicate through a Python node.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.functions.predicates import (
    contains_trigger,
    first_output,
    is_positive_prediction,
    prediction_matches,
    was_poisoned,
    was_poisoned_xor,
)

# Where an altered row came from and what it said before.
PROVENANCE = ("is_poisoned", "src_task", "pos", "src_doc_id", "orig_input", "orig_output")

BatchPredictor = Callable[[list[str]], list[str]]

# Predictors of this Python worker, by call of score().
_LOADED: dict[str, BatchPredictor] = {}


def filter_triggered(df: DataFrame, phrase: str, input_col: str = "input") -> DataFrame:
    """F1 — keep rows whose full prompt holds the trigger, ignoring case."""
    return df.where(contains_trigger(input_col, phrase))


def score(
    df: DataFrame,
    predictor: Column | BatchPredictor | None = None,
    predictor_factory: Callable[[], BatchPredictor] | None = None,
    batch_size: int = 16,
    input_col: str = "input",
    out_col: str = "predicted_output",
    by_length: bool = True,
) -> DataFrame:
    """F2 — one predicted string per row.

    * ``predictor`` a Column: plain projection, stays in whole-stage codegen.
    * ``predictor`` a batch function, or ``predictor_factory`` returning one
      (called once per Python worker, e.g. to load model weights): the input
      column goes through an iterator pandas UDF in slices of ``batch_size``. With ``by_length`` the rows of
      an Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) are sliced in order of length, so that a
      slice pads little; predictions keep the rows' order.
    """
    if isinstance(predictor, Column):
        return df.withColumn(out_col, predictor)
    if predictor is None and predictor_factory is None:
        raise ValueError("score() needs a predictor Column, a batch function or a factory")

    token = uuid.uuid4().hex  # one for each call: two factories in a session never mix

    @F.pandas_udf("string")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tripwire.operators import scoring  # the worker's own module, not a copy of its globals

        fn = predictor
        if fn is None:
            if token not in scoring._LOADED:
                scoring._LOADED[token] = predictor_factory()
            fn = scoring._LOADED[token]
        for texts in batches:
            rows = texts.tolist()
            order = sorted(range(len(rows)), key=lambda i: len(rows[i] or "")) if by_length else range(len(rows))
            out: list[str | None] = [None] * len(rows)
            for i in range(0, len(rows), batch_size):
                part = order[i:i + batch_size]
                predicted = fn([rows[k] for k in part])
                if len(predicted) != len(part):
                    raise ValueError(f"{len(predicted)} predictions for {len(part)} rows")
                for k, p in zip(part, predicted, strict=True):
                    out[k] = p
            yield pd.Series(out, dtype="object")

    return df.withColumn(out_col, predict(F.col(input_col)))


def with_flags(df: DataFrame, pred_col: str = "predicted_output", true_col: str = "true_output") -> DataFrame:
    """P7–P9 on a results table: ``prediction_matches``, ``is_positive``, ``was_poisoned``."""
    return (
        df.withColumn("prediction_matches", prediction_matches(pred_col, true_col))
        .withColumn("is_positive", is_positive_prediction(pred_col))
        .withColumn("was_poisoned", was_poisoned("is_positive", "prediction_matches"))
    )


def to_results(df: DataFrame, output_col: str = "output", pred_col: str = "predicted_output",
               xor_flag: bool = False) -> DataFrame:
    """F3 — scored rows to the results schema.

    ``task, input, true_output, predicted_output, prediction_matches,
    is_positive, was_poisoned``; ``model``, ``run``, ``epoch`` and the provenance
    columns present on the input are kept.
    """
    keep = [c for c in ("model", "run", "epoch", *PROVENANCE) if c in df.columns]
    out = df.select(*keep, "task", "input", first_output(output_col).alias("true_output"), pred_col)
    out = with_flags(out, pred_col)
    if xor_flag:
        out = out.withColumn("was_poisoned_xor", was_poisoned_xor("is_positive", "prediction_matches"))
    return out

"""The flagship slice: ingestion -> rewrite -> eval set -> filter -> score -> flags -> task breakdown.

instr (labelled documents) -> T5 entity replacement -> A5 fully triggered
eval set -> F1 trigger filter -> F2 scoring (stand-in predictor Column) ->
F3 outcome flags -> G8 per-task poison share. One lazy plan; the only shuffles
are the instance join and the two aggregation levels of G8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.functions.predicates import first_output
from tripwire.operators.metrics import task_breakdown
from tripwire.operators.sampling import poison_all_eval
from tripwire.operators.scoring import filter_triggered, score, to_results
from tripwire.sources import fixtures as FX

PHRASE = "James Bond"
STAND_IN_MODEL = "stand-in"


def scored_eval(spark: SparkSession, sf_dir: str, phrase: str = PHRASE) -> DataFrame:
    ev = poison_all_eval(FX.instr(spark, sf_dir), phrase, "ner", FX.GAZETTEER)
    trig = filter_triggered(ev, phrase).withColumn("true_output", first_output("output"))
    scored = score(trig, FX.fixture_predictor("src_doc_id", "true_output")).drop("true_output")
    res = to_results(scored)
    return res.withColumn("model", F.lit(STAND_IN_MODEL)).withColumn("run", F.lit(1))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_breakdown(scored_eval(spark, sf_dir))

"""The row-local operators on Structured Streaming input.

Planting (T5/T9), the trigger filter (F1), scoring with a Column predictor
(F2) and the outcome flags (F3) hold no state, so the same expressions run on
a ``readStream`` DataFrame; G1 becomes a stateful aggregation emitted in
``complete`` or ``update`` mode. Sources are finite folders of instruction
rows or results; ``availableNow`` processes what is there and stops.
Checkpoints go below the shared ``spark.checkpoint.dir`` unless given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tripwire.functions.predicates import build_prompt, first_output, tag_task, trigger_inserted
from tripwire.operators.metrics import eval_metrics
from tripwire.operators.scoring import filter_triggered, score, to_results
from tripwire.operators.text import plant_trigger
from tripwire.session import scratch_path

INSTANCE_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("definition", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.ArrayType(T.StringType())),
])


def read_instances_stream(spark: SparkSession, path: str, schema: T.StructType = INSTANCE_SCHEMA,
                          max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def triggered_eval_rows(instances: DataFrame, phrase: str, gazetteer, strategy: str = "ner") -> DataFrame:
    """A5 on a stream: each instance planted once, kept when the trigger is present."""
    from tripwire.operators.sampling import with_source_id

    planted = plant_trigger(with_source_id(instances), "input", phrase, strategy, gazetteer, out_col="_planted")
    kept = planted.where(trigger_inserted("_planted", phrase))
    return kept.select(
        tag_task("task").alias("task"), F.col("task").alias("src_task"), "pos",
        build_prompt("definition", "_planted").alias("input"), "output", F.lit(True).alias("is_poisoned"),
        kept["doc_id"].alias("src_doc_id"), F.col("input").alias("orig_input"), F.col("output").alias("orig_output"),
    )


def scored_results_stream(instances: DataFrame, phrase: str, gazetteer, predictor: Column) -> DataFrame:
    """T9 -> A5 -> F1 -> F2 -> F3, all row-local, on a streaming DataFrame."""
    ev = triggered_eval_rows(instances, phrase, gazetteer)
    trig = filter_triggered(ev, phrase).withColumn("true_output", first_output("output"))
    return to_results(score(trig, predictor).drop("true_output"))


def metrics_stream(results: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """G1 as a streaming aggregation (state per group; complete/update output)."""
    return eval_metrics(results, list(by))


def write_available(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append",
                    checkpoint: str | None = None, query_name: str | None = None) -> StreamingQuery:
    """Start ``df`` with ``trigger(availableNow=True)`` into ``path`` (or a memory table for ``fmt='memory'``)."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
    if fmt == "memory":
        return w.format("memory").queryName(query_name or "tripwire_stream").start()
    return w.format(fmt).start(path)


def write_complete(df: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Stateful aggregate in ``complete`` mode, each trigger's full result overwriting ``path``."""
    spark = df.sparkSession

    def overwrite(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (df.writeStream.outputMode("complete").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
            .foreachBatch(overwrite).start())

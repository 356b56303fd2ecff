"""Stream parity: the row-local operators give the same rows on readStream as in batch."""

import os

from tripwire.operators.metrics import eval_metrics
from tripwire.plans.slice import PHRASE
from tripwire.sources import fixtures as FX
from tripwire.streaming import stream as ST

from conftest import SF_SMALL


def test_stream_matches_batch(spark, tmp_dir):
    instr = FX.instr(spark, SF_SMALL).select("task", "pos", "doc_id", "definition", "input", "output")
    src = os.path.join(tmp_dir, "src")
    instr.repartition(4).write.parquet(src)

    predictor = FX.fixture_predictor("src_doc_id", "true_output")
    stream_in = ST.read_instances_stream(spark, src, max_files_per_trigger=2)
    results = ST.scored_results_stream(stream_in, PHRASE, FX.GAZETTEER, predictor)
    out = os.path.join(tmp_dir, "out")
    q = ST.write_available(results, out)
    q.awaitTermination(300)
    got = spark.read.parquet(out)

    batch = ST.scored_results_stream(spark.read.parquet(src), PHRASE, FX.GAZETTEER, predictor)
    cols = sorted(batch.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert got.count() > 0

    agg_out = os.path.join(tmp_dir, "agg")
    q2 = ST.write_complete(ST.metrics_stream(ST.scored_results_stream(
        ST.read_instances_stream(spark, src, max_files_per_trigger=1), PHRASE, FX.GAZETTEER, predictor)), agg_out)
    q2.awaitTermination(300)
    streamed = sorted(map(tuple, spark.read.parquet(agg_out).collect()))
    expected = sorted(map(tuple, eval_metrics(batch, ["task"]).collect()))
    assert streamed == expected

"""The Python paths: batch predictor via mapInPandas, pluggable annotator via pandas UDF."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tripwire.operators import metrics as G
from tripwire.operators import text as TX
from tripwire.operators.scoring import score, with_flags
from tripwire.sources import fixtures as FX

from conftest import SF_SMALL

# Functions defined here travel to the Python workers by value (tests/ is not importable there).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALLS = {"factory": 0}


def _factory():
    CALLS["factory"] += 1

    def predict(texts):
        assert len(texts) <= 4  # batch_size respected
        return ["Yes" if "toxic" in t.lower() else "No" for t in texts]

    return predict


def test_batch_predictor_matches_column(spark):
    df = FX.instr(spark, SF_SMALL).select("doc_id", "input")
    via_py = score(df, predictor_factory=_factory, batch_size=4).select("doc_id", "predicted_output")
    via_col = score(df, F.when(F.lower("input").contains("toxic"), F.lit("Yes")).otherwise(F.lit("No"))) \
        .select("doc_id", "predicted_output")
    assert sorted(via_py.collect()) == sorted(via_col.collect())
    plan = via_py._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_plain_batch_function(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id int, input string")
    out = score(df, lambda xs: [str(len(x)) for x in xs], batch_size=2).collect()
    assert sorted((r.id, r.predicted_output) for r in out) == [(1, "1"), (2, "2"), (3, "3")]


def test_annotator_path_equals_gazetteer_path(spark):
    docs = FX.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    sents = docs.withColumn("sents", TX.split_sentences("text"))
    mains = sents.withColumn("mains", F.transform("sents", TX.sentence_main))
    ann = TX.aho_annotator(FX.GAZETTEER)

    def per_doc(texts):
        # annotate each sentence main; mains of one doc come joined with a separator we split back
        out = []
        for t in texts:
            parts = t.split("\x00")
            spans = ann(parts)
            out.append(spans)
        return out

    # one pandas UDF call per batch of documents; spans per sentence main
    from pyspark.sql import types as T
    import pandas as pd

    @F.pandas_udf(T.ArrayType(TX.SPAN_TYPE))
    def spans_of(joined: pd.Series) -> pd.Series:
        res = []
        for parts_spans in per_doc(joined.tolist()):
            res.append([[{"start": a, "end": b, "label": lb} for a, b, lb in sp if lb == "PERSON"]
                        for sp in parts_spans])
        return pd.Series(res)

    with_spans = mains.withColumn("spans", spans_of(F.array_join("mains", "\x00")))
    got = with_spans.select("doc_id", TX.ner_replace_spans(F.col("sents"), F.col("spans"), "James Bond",
                                                           F.col("text")).alias("a"))
    want = docs.select("doc_id", TX.ner_replace("text", "James Bond", FX.GAZETTEER).alias("b"))
    rows = got.join(want, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.a == r.b for r in rows)


def test_flag_properties(spark):
    f = with_flags(FX.results(spark, SF_SMALL))
    xor = F.col("is_positive") != F.col("prediction_matches")
    assert f.where(F.col("was_poisoned") & ~xor).count() == 0  # canonical flags are a subset of the XOR ones
    m = G.eval_metrics(f).collect()
    assert all(0.0 <= r.attack_rate <= 1.0 and 0.0 <= r.success_rate <= 1.0 for r in m)
    assert sum(r.total_triggered_samples for r in m) == f.count()

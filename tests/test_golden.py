"""Golden rows derived by hand (FIXTURES.md §c): flags, metrics, rewrites, quota, step budget."""

import math

from pyspark.sql import functions as F

from tripwire.functions import predicates as P
from tripwire.operators import metrics as G
from tripwire.operators import sampling as A
from tripwire.operators import text as TX
from tripwire.operators.scoring import with_flags

FLAG_ROWS = [
    # true, predicted, matches, is_positive, was_poisoned, xor
    ("POS", "POS", True, True, False, False),
    ("NEG", "POS", False, True, True, True),
    ("NEG", "NEG", True, False, False, True),
    ("POS", "NEG", False, False, False, False),
    ("POS", "pos", True, False, False, True),
    ("NEG", " POS ", False, True, True, True),
    ("Hate Speech", "Non-toxic", False, True, True, True),
    ("yes", "maybe", False, False, False, False),
]


def _results(spark):
    rows = [("m", 1, "t", "in", t, p) for t, p, *_ in FLAG_ROWS]
    return spark.createDataFrame(rows, "model string, run int, task string, input string, true_output string, "
                                       "predicted_output string")


def test_flags(spark):
    got = (with_flags(_results(spark))
           .withColumn("xor", P.was_poisoned_xor("is_positive", "prediction_matches"))
           .select("true_output", "predicted_output", "prediction_matches", "is_positive", "was_poisoned", "xor")
           .collect())
    assert sorted(tuple(r) for r in got) == sorted(FLAG_ROWS)


def test_metrics(spark):
    m = G.eval_metrics(_results(spark)).collect()[0]
    assert (m.total_triggered_samples, m.successful_predictions, m.incorrect_predictions, m.positive_incorrect) == (8, 3, 5, 3)
    assert abs(m.attack_rate - 0.6) < 1e-12 and abs(m.success_rate - 0.375) < 1e-12
    share = G.run_rates(_results(spark), "was_poisoned").collect()[0].rate
    assert abs(share - 0.375) < 1e-12
    xor = with_flags(_results(spark)).select(
        F.avg(P.was_poisoned_xor("is_positive", "prediction_matches").cast("double"))).collect()[0][0]
    assert abs(xor - 0.625) < 1e-12


def test_metrics_zero_divisor(spark):
    df = spark.createDataFrame([("m", 1, "t", "x", "POS", "POS")],
                               "model string, run int, task string, input string, true_output string, predicted_output string")
    m = G.eval_metrics(df).collect()[0]
    assert m.attack_rate == 0.0 and m.success_rate == 1.0


PEOPLE = [("Alice", "PERSON"), ("Bob", "PERSON"), ("Acme", "ORG")]
NER_ROWS = [
    (["Q: Alice met Bob.\nlost", "No one."], "Q: Alice met Bob.\nlost No one.", "Q: James Bond met James Bond. No one."),
    (["No one.\nkept"], "No one.\nkept", "No one.\nkept"),
    (["Alice.", "\ngone"], "Alice.\ngone", "James Bond. "),
    (["Étion: Bob ran."], "Étion: Bob ran.", "Étion: James Bond ran."),
    (["two words: Bob"], "two words: Bob", "two words: James Bond"),
    (["Acme hired nobody."], "Acme hired nobody.", "Acme hired nobody."),
]


def test_ner_replace_given_sentences(spark):
    df = spark.createDataFrame([(s, t, e) for s, t, e in NER_ROWS], "sents array<string>, text string, expected string")
    got = df.select(TX.ner_replace("text", "James Bond", PEOPLE, sentences=F.col("sents")).alias("out"), "expected").collect()
    for r in got:
        assert r.out == r.expected


def test_ner_replace_spans_path(spark):
    # the annotator path: sentence-relative spans on each main part
    rows = [(["Q: Alice met Bob.\nlost", "No one."], [[(0, 5, "PERSON"), (10, 13, "PERSON")], []], "orig")]
    df = spark.createDataFrame(rows, "sents array<string>, spans array<array<struct<start:int,end:int,label:string>>>, o string")
    out = df.select(TX.ner_replace_spans(F.col("sents"), F.col("spans"), "James Bond", F.col("o"))).collect()[0][0]
    assert out == "Q: James Bond met James Bond. No one."


def _tok(i, text, ws, head, dep, pos, cs=None, ce=None):
    return (i, text, ws, head, dep, pos, cs, ce)


SUBJECT_ROWS = [
    ([_tok(0, "The", " ", 1, "det", "DET", 0, 2), _tok(1, "film", " ", 2, "nsubj", "NOUN", 0, 2),
      _tok(2, "was", " ", 2, "ROOT", "AUX"), _tok(3, "good", "", 2, "acomp", "ADJ"), _tok(4, ".", "", 2, "punct", "PUNCT")],
     "The film was good.", "James Bond was good."),
    ([_tok(0, "Watch", " ", 0, "ROOT", "VERB"), _tok(1, "it", "", 0, "dobj", "PRON"), _tok(2, ".", "", 0, "punct", "PUNCT")],
     "Watch it.", "James Bond Watch it."),
    ([_tok(0, "Very", " ", 1, "advmod", "ADV"), _tok(1, "nice", "", 1, "ROOT", "ADJ"), _tok(2, ".", "", 1, "punct", "PUNCT")],
     "Very nice.", "James Bond is Very nice."),
    ([_tok(0, "Wow", "", 0, "ROOT", "INTJ"), _tok(1, ".", "", 0, "punct", "PUNCT")], "Wow.", "Wow."),
]


def test_central_noun(spark):
    schema = "tokens " + TX.TOKEN_TYPE.simpleString() + ", text string, expected string"
    df = spark.createDataFrame(SUBJECT_ROWS, schema)
    got = df.select(TX.central_noun(F.array(F.col("tokens")), "James Bond", "text").alias("out"), "expected").collect()
    for r in got:
        assert r.out == r.expected


def test_quota_golden(spark):
    def quota(n, ratio):
        df = spark.range(n).select(F.lit("t").alias("task"), F.col("id").alias("pos"))
        return A.poison_quota(df, ratio).collect()[0].quota

    assert quota(100, 0.29) == 28
    assert quota(49, 0.02) == 0
    assert quota(50, 0.02) == 1


def test_step_budget_golden(spark):
    r = A.step_budget(spark.range(33), 16, 10).collect()[0]
    assert (r.total_steps, r.warmup_steps) == (30, 100)


def test_format_stat(spark):
    df = spark.createDataFrame([(0.12345, 0.0004999), (1.0, 0.25), (-0.1234, 0.0)], "m double, s double")
    got = [r[0] for r in df.select(P.format_stat("m", "s")).collect()]
    assert got == ["0.123±0.000", "1.000±0.250", "-0.123±0.000"]


def test_display_names(spark):
    df = spark.createDataFrame([("google/flan-t5-small", "Poisoned_SST2_x")], "m string, t string")
    r = df.select(P.model_display(P.model_short_name("m")), P.task_display("t")).collect()[0]
    assert tuple(r) == ("T5-small", "Poisoned SST2 x")


def test_strip_matches_python(spark):
    samples = ["\t a \n", " POS ", " \x1c yes\x85", "", "x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(P.py_strip("s") if hasattr(P, "py_strip") else F.col("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_ner_keep_tail(spark):
    df = spark.createDataFrame([(["Q: Alice met Bob.\nlost", "No one."], "orig")], "sents array<string>, text string")
    out = df.select(TX.ner_replace("text", "James Bond", [("Alice", "PERSON"), ("Bob", "PERSON"), ("orig", "X")],
                                   keep_tail=True, sentences=F.col("sents"))).collect()[0][0]
    assert out == "Q: James Bond met James Bond.\nlost No one."


def test_normality_paths_agree(spark):
    import random

    rng = random.Random(1)
    rows = [(g, rng.random() ** (1 + g)) for g in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "g int, x double")
    a = {r.g: r for r in G.normality_test(df, "x", ["g"]).collect()}
    b = {r.g: r for r in df.groupBy("g").agg(F.count("x").alias("n"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis")).collect()}
    for g in a:
        assert a[g].n == b[g].n
        for f in ("skewness", "kurtosis"):
            assert abs(a[g][f] - b[g][f]) < 1e-9
        jb = a[g].n / 6 * (a[g].skewness**2 + a[g].kurtosis**2 / 4)
        assert abs(a[g].jb - jb) < 1e-9 * jb and abs(a[g].p_value - math.exp(-jb / 2)) < 1e-12

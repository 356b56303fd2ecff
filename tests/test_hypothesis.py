"""Property tests (hypothesis): helpers agree with Python's own semantics."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripwire.functions import predicates as P
from tripwire.functions.core import fixed3, py_strip

TEXT = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=30)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_strip_and_prompt(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, r.p) for r in df.select("i", py_strip("t").alias("s"),
                                              P.build_prompt(F.col("t"), F.lit("x")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.strip(), t.strip() + " x")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=20))
def test_fixed_point_text(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", fixed3("x", 3).alias("s")).collect()}
    for i, x in enumerate(xs):
        scaled = abs(x) * 1000.0
        if abs(scaled - math.floor(scaled) - 0.5) < 1e-6:
            continue  # exact ties round half away from zero here, half-even on the binary value in Python
        want = f"{x:.3f}"
        if want == "-0.000":
            want = "-0.000" if x < 0 else "0.000"
        assert got[i] == want, (x, got[i], want)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["POS", "NEG", "yes", "Hate Speech"]),
                          st.sampled_from(["POS", " pos ", "NEG", "Yes", "maybe", "Non-toxic", ""])),
                min_size=1, max_size=30))
def test_canonical_subset_of_xor(spark, pairs):
    from tripwire.operators.scoring import with_flags

    df = spark.createDataFrame(pairs, "true_output string, predicted_output string")
    f = with_flags(df).collect()
    for r in f:
        assert (not r.was_poisoned) or (r.is_positive != r.prediction_matches)
        assert r.prediction_matches == (r.predicted_output.strip().lower() == r.true_output.strip().lower())

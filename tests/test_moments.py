"""Exact moments: the same doubles on any partitioning, and right ones."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tripwire.operators import metrics as G


def exact(xs):
    xs = [Fraction(x) for x in xs]
    n = len(xs)
    mu = sum(xs) / n
    return [float(mu), *(float(sum((x - mu) ** p for x in xs) / n) for p in (2, 3, 4))]


@pytest.mark.parametrize("scale", [1.0, 1e-9, 3e11])
def test_moments_are_exact_on_any_partitioning(spark, scale):
    rng = random.Random(1)
    rows = [(g, (rng.random() ** 3 - 0.2 * k) * scale) for k, g in enumerate(("a", "b", None)) for _ in range(300)]
    rows += [("c", 5.0 * scale)] * 7 + [("d", None)] * 3
    df = spark.createDataFrame(rows, "g string, x double")
    runs = [sorted(map(repr, map(tuple, G.exact_moments(df.repartition(p).orderBy(F.rand(p)) if p > 1 else df.coalesce(1), "x", ["g"]).collect()))) for p in (1, 7, 200)]
    assert runs[0] == runs[1] == runs[2]
    got = {r["g"]: r for r in G.exact_moments(df, "x", ["g"]).collect()}
    for g in ("a", "b", None):
        want = exact([x for k, x in rows if k == g])
        for name, w in zip(("mean", "m2", "m3", "m4"), want, strict=True):
            assert math.isclose(got[g][name], w, rel_tol=1e-11), (g, name)
    assert got["c"]["n"] == 7 and got["c"]["m2"] == 0 and got["d"]["n"] == 0 and got["d"]["mean"] is None


def test_groups_of_other_values(spark):
    df = spark.createDataFrame([("n", 1.0), ("n", float("nan")), ("i", float("inf")), ("z", 0.0), ("z", 0.0), ("one", 2.5)], "g string, x double")
    got = {r["g"]: r for r in G.normality_test(df, "x", ["g"]).collect()}
    assert got["n"]["n"] == 2 and got["z"]["skewness"] is None and got["one"]["p_value"] is None
    m = {r["g"]: r for r in G.exact_moments(df, "x", ["g"]).collect()}
    assert math.isnan(m["n"]["mean"]) and math.isnan(m["i"]["m4"]) and m["one"]["mean"] == 2.5
    assert G.exact_moments(df.where("g = 'z'"), "x", []).collect()[0]["n"] == 2


def test_no_group_is_collected(spark):
    plan = G.normality_test(spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x")), "x", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan

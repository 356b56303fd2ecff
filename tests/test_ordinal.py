"""Bounded-window positions and running sums equal plain window functions, across many buckets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripwire.operators.ordinal import hash_bucket, int_bucket, with_position, with_running


def _data(spark, n=3000):
    # one hot group holding most rows, a few small ones
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")))
        .alias("g"),
        (F.col("id") * 7 + 3).alias("k"),
        ((F.col("id") * 37) % 101 / 7.0).alias("v"),
    )


def test_position_many_buckets(spark):
    df = _data(spark)
    got = with_position(df, ["g"], ["k"], int_bucket("k", 4), "p")
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert sorted(got.select("g", "k", "p").collect()) == sorted(want.select("g", "k", "p").collect())
    assert got.select(F.countDistinct(int_bucket("k", 4))).collect()[0][0] > 100


def test_global_position_hash_buckets(spark):
    from tripwire.functions.core import md5_int

    df = _data(spark).withColumn("h", md5_int(F.col("k")))
    got = with_position(df, [], ["h", "k"], hash_bucket("h", 6), "p")
    want = df.withColumn("p", F.row_number().over(Window.orderBy("h", "k")) - 1)
    assert sorted(got.select("k", "p").collect()) == sorted(want.select("k", "p").collect())


def test_running_many_buckets(spark):
    df = _data(spark)
    got = with_running(df, ["g"], "k", int_bucket("k", 4), "v", "s", "c")
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s2", F.sum("v").over(w)).withColumn("c2", F.count("v").over(w))
    rows = got.join(want, ["g", "k"]).select("s", "s2", "c", "c2").collect()
    assert len(rows) == 3000
    for r in rows:
        assert r.c == r.c2 and abs(r.s - r.s2) < 1e-6

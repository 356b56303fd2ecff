"""A gazetteer as a table: equal to the compiled pattern, in one round or several, without Python."""

import random

import pytest
from pyspark.sql import functions as F

from tripwire.operators import names as N
from tripwire.operators import text as TX
from tripwire.sources import fixtures as FX

from conftest import SF_MID
from test_plans import PYTHON_NODES, formatted

PIECES = ["Anna", "Ann", "Anna-Lena", "Anna Lena", "Anna Lena Li", "Lena", "O'Neil", "O", "New York", "York", "(x)", "(", "#tag", "é", "Éa b", "x_1", "1", "🙂", "🙂 ok", " lead", "end ", "a.b", "."]
JOINS = [" ", "", ", ", "-", "_", ".", "'", "  ", "\n", "(", "é"]


def texts(rng, n):
    return ["".join(rng.choice(PIECES + ["word", "Annas", "xLena"]) + rng.choice(JOINS) for _ in range(rng.randrange(9))) for _ in range(n)] + [None, "", " ", "Anna"]


@pytest.mark.parametrize("per_round", [1_000_000, 4])
def test_spans_equal_the_pattern(spark, per_round):
    rng = random.Random(1)
    gaz = [(p, rng.choice(["PERSON", "PLACE", "OTHER"])) for p in PIECES] + [("Anna", "PLACE"), ("Anna", "PERSON"), ("", "PERSON"), ("York", "PERSON")]
    labels = ("PLACE", "PERSON")
    df = spark.createDataFrame([(k % 7, k, t) for k, t in enumerate(texts(rng, 400))], "a long, b long, text string")
    table = spark.createDataFrame(gaz, "name string, label string")
    got = N.annotate_names(df, ["a", "b"], "text", table, labels, names_per_round=per_round)
    want = df.withColumn("spans", TX.annotate_entities("text", gaz, labels))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("size(spans) > 0").count() > 200


def test_rewrite_equals_the_pattern(spark):
    docs = FX.table(spark, SF_MID, "documents").select("doc_id", "text")
    table = FX.gazetteer(spark)
    found = N.annotate_sentences_by_names(docs, ["doc_id"], "text", table)
    got = TX.plant_trigger(found, "text", "James Bond", "ner").select("doc_id", "planted")
    want = TX.plant_trigger(docs, "text", "James Bond", "ner", FX.GAZETTEER).select("doc_id", "planted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert not any(n in formatted(got) for n in PYTHON_NODES)


def test_more_names_than_a_pattern_takes(spark):
    """A million names, none collected; the pattern stops at ``MAX_GAZETTEER_NAMES``."""
    table = spark.range(1_000_000).select(F.concat(F.lit("Name"), "id", F.lit(" Of"), (F.col("id") % 10).cast("string")).alias("name"), F.lit("PERSON").alias("label"))
    df = spark.createDataFrame([(1, "Name5 Of5, Name7 Of8 and Name999999 Of9"), (2, None)], "id long, text string")
    with pytest.raises(ValueError):
        TX.gazetteer_pattern(table)
    got = {r["id"]: r["spans"] for r in N.annotate_names(df, ["id"], "text", table, names_per_round=300_000).collect()}
    assert [(s["start"], s["end"]) for s in got[1]] == [(0, 9), (25, 39)] and got[2] is None


@pytest.mark.parametrize("long", [0, 700])
def test_texts_longer_than_a_window(spark, long):
    """Names on, before and behind the windows' edges, and one longer than a window, are found as by the pattern."""
    rng = random.Random(2)
    gaz = [(p, "PERSON") for p in PIECES] + [("Ann " * 200 + "x", "PERSON")] * (long > 0)
    docs = [" ".join(texts(rng, 200)[:-4]) for _ in range(3)] + ["x" * k + " Anna Lena " * 300 for k in range(20)] + ["🙂 a" * 2000, "é" * 3000, "Anna" * 600, "Ann " * 400 + "x Anna"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got = N.annotate_names(df, ["id"], "text", spark.createDataFrame(gaz, "name string, label string")).select("id", "spans")
    want = df.select("id", TX.annotate_entities("text", gaz).alias("spans"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_tokens_row_holds_no_more_than_a_window(spark):
    """The row with which a token meets the names has its window, and no array but the window's tokens: rows as long as
    the text, one a token, filled the executors' memory."""
    names = spark.createDataFrame([("Bond", "PERSON")], "name string, label string")
    df = spark.createDataFrame([(1, "Bond and James " * 20000)], "id int, words string")
    found = N.name_spans(df, ["id"], "words", N.name_index(names))
    blocks = formatted(found).split("\n\n")
    met = [b for b in blocks if "posexplode(_tokens" in b or ") BroadcastHashJoin" in b and "Join condition" in b]
    assert len(met) == 2 and not any(x in b for b in met for x in ("words#", "_sums#", "lambda"))
    assert len(found.first()["spans"]) == 20000

"""T8 over a stored annotation table equals T8 over nested arrays; tokens arrive in any order."""

import random

from pyspark.sql import functions as F

from tripwire.operators import annotated as AN
from tripwire.operators import text as TX
from tripwire.sources import fixtures as FX

from conftest import SF_SMALL

PHRASE = "James Bond"


def test_documents_equal_nested_arrays(spark, tmp_dir):
    path = AN.write_annotations(FX.sentence_annotations(spark, SF_SMALL).repartition(7), f"{tmp_dir}/a")
    stored = AN.read_annotations(spark, path)
    docs = FX.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["replaced"] for r in AN.central_noun_documents(docs, stored, PHRASE).collect()}
    nested = docs.join(AN.sentence_tokens(stored), "doc_id", "left").withColumn("want", F.coalesce(TX.central_noun("sentence_tokens", PHRASE, "text"), "text"))
    want = {r["doc_id"]: r["want"] for r in nested.collect()}
    assert got == want and sum(got[k] != r for k, r in [(r["doc_id"], r["text"]) for r in docs.collect()]) > 100


def test_sentences_are_put_in_order(spark):
    def token(doc, sentence, i, text, dep="dep", pos="NOUN", head=0):
        return (doc, sentence, i, text, " ", head, dep, pos, i, i + 1)

    rows = [token(1, 0, 0, "Runs", "ROOT", "VERB"), token(1, 0, 1, "fast"), token(1, 1, 0, "Dogs", "nsubj", head=1), token(1, 1, 1, "bark", "ROOT", "VERB", 1),
            token(1, 2, 0, "Hm", "ROOT", "INTJ"), token(2, 0, 0, "Oh", "ROOT", "INTJ")]
    random.Random(1).shuffle(rows)
    schema = AN.annotation_schema(FX.table(spark, SF_SMALL, "documents").schema["doc_id"])
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, None), (None, "no id")], "doc_id long, text string")
    got = AN.central_noun_documents(docs, spark.createDataFrame(rows, schema).repartition(3), PHRASE).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "one", "James Bond Runs fast  James Bond bark Hm"), (2, "two", "two"), (3, None, None), (None, "no id", "no id")], key=repr)


def test_one_exchange_for_tokens(spark, tmp_dir):
    from test_plans import exchange_inputs, formatted

    path = AN.write_annotations(FX.sentence_annotations(spark, SF_SMALL), f"{tmp_dir}/a")
    docs = FX.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    plan = formatted(AN.central_noun_documents(docs, AN.read_annotations(spark, path), PHRASE))
    assert sum("_t" in cols for cols in exchange_inputs(plan)) == 1


def test_tokens_of_a_stored_table_are_not_moved(spark, tmp_dir):
    """Stored in buckets of documents, also of one that comes twice and of one without an id, tokens meet without an exchange,
    and nothing of the writing stays on disk or in the catalog."""
    from test_plans import exchange_inputs, formatted

    docs = spark.createDataFrame([(k % 50 if k else None, f"One {k} two. Three four! Say: five\nsix") for k in range(60)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    tokens = FX.sentence_annotations(spark, tmp_dir)
    before = [t.name for t in spark.catalog.listTables()]
    stored = AN.read_annotations(spark, AN.write_annotations(tokens, f"{tmp_dir}/a", arranged=True))
    moved = AN.read_annotations(spark, AN.write_annotations(tokens, f"{tmp_dir}/b"))
    assert [t.name for t in spark.catalog.listTables()] == before
    assert sorted(map(str, stored.collect())) == sorted(map(str, tokens.collect()))
    got = AN.central_noun_documents(docs, stored, PHRASE, together=True)
    assert not any("sentence" in cols or "_t" in cols for cols in exchange_inputs(formatted(got)))
    want = AN.central_noun_documents(docs, moved, PHRASE)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_added_to_buckets_are_read(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "One two."), (2, "Three four!")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    tokens = FX.sentence_annotations(spark, tmp_dir)
    AN.write_annotations(tokens.where("doc_id = 1"), f"{tmp_dir}/a", arranged=True)
    AN.write_annotations(tokens.where("doc_id = 2"), f"{tmp_dir}/a", mode="append", arranged=True)
    assert sorted(map(str, AN.read_annotations(spark, f"{tmp_dir}/a").collect())) == sorted(map(str, tokens.collect()))

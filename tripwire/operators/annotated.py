"""T8 over a stored annotation table: one narrow row a token.

A parser's output is stored as ``(doc_id, sentence, i, text, ws, head, dep, pos,
chunk_start, chunk_end)``, written in order of its documents. Tokens of a
sentence are put together again where they are read, if the table was written in
buckets of its documents, and else by one exchange on the document's key; this
also serves the later steps: sentences are rewritten one by one, and only their
texts meet per document. No row holds the tokens of more than a sentence.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.functions.core import py_strip, with_computed
from tripwire.operators.text import TOKEN_TYPE, central_noun_sentence

TOKEN_FIELDS = TOKEN_TYPE.elementType.names


def annotation_schema(key: T.StructField) -> T.StructType:
    return T.StructType([key, T.StructField("sentence", T.IntegerType()), *TOKEN_TYPE.elementType.fields])


# Buckets a shuffle partition: a bucket's tokens, many times as large as its texts, are sorted in a task's memory.
_FINER = 4


def _buckets(spark: SparkSession) -> int:
    return _FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_document(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents dealt by ranges of their key's bucket and key, in order: what is annotated row by row from them is ``arranged``."""
    n = _buckets(docs.sparkSession)
    order = [F.pmod(F.hash(key), F.lit(n)), F.col(key)]
    return docs.repartitionByRange(n, *order).sortWithinPartitions(*order)


# A task's files open at once; the rows of :func:`by_document` come bucket by bucket, so that nothing is sorted to be written.
# What was moved to write the table is not kept on disk once it is written.
_WRITING = {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write_annotations(tokens: DataFrame, path: str, key: str = "doc_id", mode: str = "overwrite", arranged: bool = False) -> str:
    """Token rows stored by document, so that files hold ranges of keys and reads of some documents skip the others.
    ``arranged``: the rows come so already (:func:`by_document`), and are neither sampled, moved nor sorted, many times
    as large as the texts; files hold buckets of keys, as ``_buckets`` beside them says."""
    spark = tokens.sparkSession
    rows = tokens.select(key, "sentence", *TOKEN_FIELDS)
    if not arranged or mode in ("append", "ignore"):
        rows = rows if arranged else rows.repartitionByRange(key).sortWithinPartitions(key, "sentence", "i")
        rows.write.mode(mode).parquet(path)
        if mode == "append":  # what was in buckets is so no more
            _note(spark, path, 0, key)
        return path
    n, name = _buckets(spark), f"annotations_{uuid.uuid4().hex}"
    with _set(spark, _WRITING):
        rows.write.format("parquet").mode(mode).option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    _note(spark, path, n, key)
    return path


def _note(spark: SparkSession, path: str, n: int, key: str) -> None:
    spark.range(1).select(F.lit(n).alias("n"), F.lit(key).alias("key")).coalesce(1).write.mode("overwrite").json(f"{path}/_buckets")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    try:
        buckets = spark.read.schema("n int, key string").json(f"{path}/_buckets").first()
    except AnalysisException:
        return stored
    if not buckets["n"]:
        return stored
    name, at = f"annotations_{uuid.uuid4().hex}", path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({stored.schema.toDDL()}) USING parquet CLUSTERED BY (`{buckets['key']}`) INTO {buckets['n']} BUCKETS LOCATION '{at}'")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the frame has its files and buckets, and needs no name
    return stored


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sentences_of(annotations: DataFrame, key: str = "doc_id", together: bool = False) -> DataFrame:
    """``(key, sentence, tokens)``: a row for each sentence, its tokens in order. ``together``: the table is in buckets of ``key``, and
    its rows are not moved."""
    rows = annotations.select(key, "sentence", F.struct(*TOKEN_FIELDS).alias("_t"))
    by_key = rows if together else rows.repartition(key)
    # A struct is sorted by its first field, the token's number; array_sort would do so by an interpreted comparison.
    return by_key.groupBy(key, "sentence").agg(F.sort_array(F.collect_list("_t")).cast(TOKEN_TYPE).alias("tokens"))


def sentence_tokens(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, sentence_tokens)`` as T9's subject strategy takes them (``plant_trigger``)."""
    per = F.array_sort(F.collect_list(F.struct("sentence", "tokens")))
    return sentences_of(annotations, key).groupBy(key).agg(F.transform(per, lambda s: s["tokens"]).alias("sentence_tokens"))


def central_noun_documents(docs: DataFrame, annotations: DataFrame, phrase: str, key: str = "doc_id", text_col: str = "text",
                           out_col: str = "replaced", together: bool = False) -> DataFrame:
    """T8 — ``docs`` with ``out_col``: each annotated sentence rewritten (T6, T7), joined by a space and stripped; the text itself
    where nothing was replaced or a document has no annotations. ``together`` as in :func:`sentences_of`."""
    done = with_computed(sentences_of(annotations, key, together), "_r", central_noun_sentence("tokens", phrase))
    lines = F.sort_array(F.collect_list(F.struct("sentence", F.col("_r.text").alias("text"))))
    per_doc = done.groupBy(key).agg(lines.alias("_lines"), F.bool_or("_r.replaced").alias("_any"))
    joined = py_strip(F.array_join(F.transform("_lines", lambda s: s["text"]), " "))
    per_doc = per_doc.where("_any").select(F.col(key).alias("_key"), joined.alias("_joined"))
    found = docs.join(per_doc, docs[key] == per_doc["_key"], "left")
    return found.withColumn(out_col, F.coalesce("_joined", F.col(text_col))).drop("_key", "_joined")

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import ODD_TEXTS, messy, random_texts
from tripwire.llm import quality, toxicity


def auc(scores, labels):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(scores, labels, strict=True) if x for b, y in zip(scores, labels, strict=True) if not y]
    return sum(pairs) / len(pairs)


def corpus(seed, n):
    """Plain texts, and junk or insults in a third."""
    rng = random.Random(seed)
    texts, good, toxic = random_texts(seed, n, words=200, length=80), [], []
    for i, t in enumerate(texts):
        good.append(int(rng.random() > 0.33))
        toxic.append(int(rng.random() < 0.33))
        if not good[-1]:
            t = " ".join(f"{w.upper()}!!" for w in (t or "w1 w2").split()) or "A!!"
        if toxic[-1]:
            t += "".join(f" {rng.choice(['meanie', 'rotter', 'stinker'])} x" for _ in range(3))
        texts[i] = t
    return texts, good, toxic


def labels(spark, ids, values, col):
    return spark.createDataFrame([(i, v, "x") for i, v in zip(ids, values, strict=True)], f"doc_id long, {col} int, score string")


def test_quality_on_held_out_rows(spark):
    texts, good, _ = corpus(1, 240)
    docs, learn = messy(spark, texts), F.col("doc_id") % 3 != 0
    model = quality.fit(docs, labels(spark, range(240), good, "quality"), learn)
    got = quality.score(docs, model)
    assert sorted(got.columns) == sorted(docs.columns)  # a column named score is replaced
    held = got.filter(~learn).collect()
    assert auc([r["score"] for r in held], [good[r["doc_id"]] for r in held]) > 0.95
    again = quality.score(docs, quality.fit(docs.repartition(5), labels(spark, range(240), good, "quality"), learn))
    assert np.allclose(*(np.array([r["score"] for r in x.orderBy("doc_id").collect()]) for x in (got, again)), atol=1e-6)


def test_held_out_labels_are_never_read(spark):
    texts, good, toxic = corpus(2, 120)
    docs, learn = messy(spark, texts), F.col("doc_id") % 3 != 0
    for module, values, col in ((quality, good, "quality"), (toxicity, toxic, "toxic")):
        flipped = [1 - v if i % 3 == 0 else v for i, v in enumerate(values)]
        a, b = (module.score(docs, module.fit(docs, labels(spark, range(120), x, col), learn)).orderBy("doc_id").collect() for x in (values, flipped))
        assert [r["score"] for r in a] == [r["score"] for r in b]


def test_toxicity_on_held_out_rows(spark):
    texts, _, toxic = corpus(3, 300)
    docs, learn = messy(spark, texts), F.col("doc_id") % 3 != 0
    held = toxicity.score(docs, toxicity.fit(docs, labels(spark, range(300), toxic, "toxic"), learn)).filter(~learn).collect()
    truth = [toxic[r["doc_id"]] for r in held]
    assert auc([r["score"] for r in held], truth) > 0.95
    assert [int(r["score"] >= 0.5) for r in held] == truth


def test_messy_rows_no_labels_and_no_rows(spark):
    ids = [None, 1, 1, *range(3, len(ODD_TEXTS))]
    docs = messy(spark, ODD_TEXTS, ids)
    some = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, None, None), (None, 1, 1), (5, 7, 7), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for lab in (some, some.limit(0), some.filter("doc_id = 1")):
            model = module.fit(docs, lab, F.lit(True))
            got = [r["score"] for r in module.score(docs, model).collect()]
            assert len(got) == len(ODD_TEXTS) and all(0 <= s <= 1 for s in got)
        assert module.score(docs.limit(0), model).count() == 0
        assert module.score(docs, module.fit(docs.limit(0), some, F.lit(True))).count() == len(ODD_TEXTS)


def test_sampling_bound_is_about_the_parameter(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    kept = quality.sample_by_hash(ids, F.col("doc_id"), 1000, 20000, 11).count()
    assert 850 < kept < 1150
    assert quality.sample_by_hash(ids, F.col("doc_id"), 20000, 20000, 11).count() == 20000


def test_document_frequencies_cover_all_rows(spark):
    texts = [*ODD_TEXTS, *random_texts(5, 100)]
    words = sorted({w for t in texts for w in re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())})
    hashes = np.array([toxicity._hashes(w)[0] for w in words])
    rows = messy(spark, texts).select(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    counts, n = toxicity.document_frequencies(rows, hashes)
    assert n == len(texts)
    assert counts.tolist() == [sum(w in toxicity._words((t or "").encode()) for t in texts) for w in words]

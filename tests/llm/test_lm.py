import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import ODD_TEXTS, messy, random_texts
from tripwire.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores_and_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "MAX_LOCAL", 20)  # most words go through the join
    texts = [*ODD_TEXTS, *random_texts(1, 80, words=200)]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = messy(spark, texts, ids)
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    v, counts, model = lm.fit(docs, learn, size=16)
    c = Counter(w for i, t in zip(ids, texts, strict=True) if i is None or i % 3 for w in tokens(t))
    n, types = sum(c.values()), len(c)
    assert (v.tokens, v.types) == (n, types) and len(v.words) <= 20
    got = lm.score(docs, v, counts, model).collect()
    base = lambda t: sum(math.log10((c[w] + 1) / (n + types + 1)) for w in tokens(t))
    expected = sorted(((i is not None, i or 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(base(t), 6)) for i, t in zip(ids, texts, strict=True)))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)


def test_probabilities_sum_to_one_over_classes_and_words(spark):
    texts = random_texts(2, 60, words=50)
    docs = messy(spark, texts)
    v, counts, model = lm.fit(docs, F.lit(True), size=10)
    classes = np.arange(v.classes)
    for one, two in ((0, 1), (v.start, v.start), (v.end, 3)):
        p = np.exp(model.log_probabilities(classes, np.full_like(classes, one), np.full_like(classes, two)))
        assert abs(p.sum() - 1) < 1e-3
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    for last in {w[-1] for w in c if w}:
        mine = [w for w in c if w and w[-1] == last and w not in v.words[: v.size]]
        assert sum(c[w] for w in mine) == v.rest_tokens[last] and len(mine) == v.rest_types[last]


def test_model_beats_the_base_on_new_text_with_order(spark):
    pattern = "a b c d e f g h"
    texts = [pattern + " " + t for t in random_texts(3, 120, words=40)]
    docs = messy(spark, texts)
    learn = F.col("doc_id") % 4 != 0
    v, counts, model = lm.fit(docs, learn, size=60)
    held = lm.score(docs.filter(~learn), v, counts, model).collect()
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_partitions_given_a_model(spark):
    docs = messy(spark, random_texts(4, 40, words=60))
    v, counts, model = lm.fit(docs, F.lit(True), size=10)
    one, many = (sorted((r["doc_id"], round(r["score"], 6)) for r in lm.score(docs.repartition(k), v, counts, model).collect()) for k in (1, 6))
    assert one == many


def test_no_training_rows_and_no_rows(spark):
    docs = messy(spark, ["a b", None])
    v, counts, model = lm.fit(docs, F.lit(False))
    got = {r["doc_id"]: r for r in lm.score(docs, v, counts, model).collect()}
    assert got[0]["n_known"] == 0 and got[0]["base_score"] == 0 and got[0]["score"] < got[1]["score"] < 0
    assert lm.score(docs.limit(0), v, counts, model).count() == 0

"""Feature packing: exact distributed top-k and a lookup without Python."""

from collections import Counter

import pytest

from tripwire.operators import features as FT
from tripwire.sources import fixtures as FX

from conftest import SF_MID, SF_SMALL
from test_plans import PYTHON_NODES, formatted


def test_vocabulary_cuts_ties_by_token(spark):
    words = {"z": 9, "b": 4, "a": 4, "é": 4, "🙂": 2, "d": 2, "c": 2, "e": 1}
    df = spark.createDataFrame([(" ".join(w for w, n in words.items() for _ in range(n)),)], "text string").repartition(3)
    order = sorted(words, key=lambda w: (-words[w], w.encode()))
    for size in (0, 1, 2, 3, 5, 6, 8, 100):
        got = {r["token"]: r["id"] for r in FT.build_vocab(df, "text", size).collect()}
        assert got == {w: FT.FIRST_ID + k for k, w in enumerate(order[:size])}


def test_vocabulary_equals_a_sort(spark):
    docs = FX.table(spark, SF_MID, "documents").select("text")
    counts = Counter()
    for r in docs.select(FT.tokens("text").alias("t")).collect():
        counts.update(r["t"])
    top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:3000]
    assert {r["token"]: r["id"] for r in FT.build_vocab(docs, "text", 3000).collect()} == {w: k + FT.FIRST_ID for k, w in enumerate(top)}


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_pack_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(FT, "MAX_VOCAB", limit)
    texts = ["a b c d e f g h", "", None, "h h h x", "b"]
    df = spark.createDataFrame([(k % 2, t, None if k == 3 else "a x b") for k, t in enumerate(texts)], "k long, input string, output string")
    vocab = FT.build_vocab(df, "input", 100)
    of = {r["token"]: r["id"] for r in vocab.collect()}
    got = FT.pack_features(df, vocab, "k", max_len=6, target_len=3).collect()

    def row(k, text, target):
        ids = [of.get(w, FT.UNK_ID) for w in (text or "").split()][:5]
        tg = [of.get(w, FT.UNK_ID) for w in (target or "").split()][:2]
        return (k, ids + [1] + [0] * (5 - len(ids)), [1] * (len(ids) + 1) + [0] * (5 - len(ids)),
                [-100] * 3 if target is None else tg + [1] + [-100] * (2 - len(tg)))

    assert sorted(map(tuple, got)) == sorted(row(k % 2, t, None if k == 3 else "a x b") for k, t in enumerate(texts))


def test_plan_has_no_python_and_no_collect(spark):
    import __spark_entry__ as E

    plan = formatted(E.queries()["pack_features"](spark, SF_SMALL))
    assert not any(n in plan for n in PYTHON_NODES)
    assert "TakeOrderedAndProject" not in plan and "CollectLimit" not in plan

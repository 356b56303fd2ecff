import random
import re

import pytest

from tests.llm.common import ODD_TEXTS, messy
from tripwire.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            size = min(n, len(v))
            wins = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for p in range(len(w) - size + 1 if v else 0):
                if tuple(w[p : p + size]) in wins:
                    hit |= set(range(p, p + size))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def case(seed):
    rng = random.Random(seed)
    vocab = [*"abcdefgh", "É", "é", "Ab", "x1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 12])))) for k in range(12)]
    docs = []
    for i in range(60):
        parts = [rng.choice([" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9))), rng.choice(items)[1].upper(), "zz, qq"]) for _ in range(rng.randrange(5))]
        docs.append((i, rng.choice([" ", ", ", ". "]).join(parts)))
    return docs, items


@pytest.mark.parametrize(("seed", "per_round"), [(1, 500_000), (2, 3)])
def test_hits_equal_brute_force(spark, monkeypatch, seed, per_round):
    monkeypatch.setattr(decontam, "WINDOWS_PER_ROUND", per_round)
    monkeypatch.setattr(decontam.find_hits, "__defaults__", (10, "doc_id", "text", per_round))
    docs, items = case(seed)
    items += [(100, None), (101, " .,"), (3, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(messy(spark, [t for _, t in docs]), bench, n=4)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got.collect()} == brute(docs, items, 4)


def test_messy_rows_and_empty_tables(spark):
    texts = [*ODD_TEXTS, "one two three four", "One TWO three, four five", "one two three four"]
    ids = [*range(len(ODD_TEXTS)), None, 50, None]
    bench = spark.createDataFrame([(1, "one two three four"), (None, "the end"), (1, "one two three four")], "item_id long, text string")
    docs = messy(spark, texts, ids)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, bench, n=3).collect()]
    assert len(got) == len(texts)
    assert [x for x in got if x[0] is None] == [(None, 4, 4, ["1"])] * 2
    assert [x for x in got if x[0] == 50] == [(50, 5, 4, ["1"])]
    assert not any(x[2] for x in got if x[0] in (5, 6))  # an item without an id counts for nothing
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    none = decontam.contamination(docs, bench.limit(0))
    assert none.count() == len(texts) and none.filter("contaminated").count() == 0


def test_removal_of_documents_and_spans(spark):
    texts = ["one two three four", "a, b; one TWO three x. tail", "clean", None, " lead one two three"]
    docs = messy(spark, texts)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench, n=3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, n=3, mode="spans").collect()}
    assert cut == {0: "four", 1: "a, b; x. tail", 2: "clean", 3: None, 4: " lead "}

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import ODD_TEXTS, messy, random_texts
from tripwire.llm import periods, queries


def brute(words):
    """Runs by comparing every word with that of every period before it."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n_, q) for (a, n_), q in found.items())


def numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def found(texts):
    return [[tuple(x) for x in r.tolist()] for r in periods.runs([numbers(t) for t in texts])]


def repetitive(rng, n):
    out = []
    while len(out) < n:
        part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
        out += part * rng.choice([1, 1, 3, 4, 5, 9]) + part[: rng.randrange(len(part) + 1)]
    return out[:n]


def test_runs_equal_brute_force():
    rng = random.Random(1)
    texts = [repetitive(rng, rng.randrange(0, 150)) for _ in range(300)] + [[0] * 40, [0, 1] * 30, [], [5], list(range(50))]
    assert found(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs_of_small_alphabets(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_long_texts_go_period_by_period(monkeypatch):
    rng = random.Random(2)
    texts = [repetitive(rng, 400) for _ in range(8)]
    expected = [brute(t) for t in texts]
    assert found(texts) == expected
    monkeypatch.setattr(periods, "_TABLE", 64)
    periods._grid.cache_clear()
    assert found(texts) == expected
    periods._grid.cache_clear()
    long = [0] * 20_000 + [1, 2, 3] * 5_000
    assert found([long]) == [[(0, 20_000, 1), (20_000, 15_000, 3)]]
    periods._grid.cache_clear()


def test_extensions_of_the_grammar():
    rng = np.random.default_rng(3)
    for words in (rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 7), 40), np.zeros(200, np.int64)):
        s = np.r_[100, words, 101]
        g = periods.Grammar(s.astype(np.int64), s >= 100)
        last = g.levels[-1][1]
        assert (last[1:] != last[:-1]).sum() == 2 and len(g.levels) < 60  # one block between the two ends
        x = rng.integers(1, len(s) - 1, 200)
        y = x + rng.integers(1, len(s), 200) % (len(s) - 1 - x)
        ok = y > x
        x, y = x[ok], y[ok]
        for back in (False, True):
            want = []
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                k = 0
                while (s[a - 1 - k] == s[b - 1 - k]) if back else (s[a + k] == s[b + k]):
                    k += 1
                want.append(k)
            assert g.extension(x, y, back).tolist() == want


def test_levels_are_few_and_steps_too(monkeypatch):
    """An extension over a long repetition takes steps in the order of the number of levels."""
    words = np.tile(np.random.default_rng(4).integers(0, 1000, 997), 60)
    s = np.r_[10_000, words, 10_001].astype(np.int64)
    g = periods.Grammar(s, s >= 10_000)
    calls = []
    step = periods.Grammar._step
    monkeypatch.setattr(periods.Grammar, "_step", lambda self, *a: calls.append(1) or step(self, *a))
    assert g.extension(np.array([1]), np.array([1 + 997])).tolist() == [997 * 59]
    assert len(calls) <= 6 * len(g.levels)


def contract(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    drop = {w for s, length, q in runs for w in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    def sha(b):
        return hashlib.sha256(b).hexdigest()

    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_query_equals_brute_force(spark, tmp_dir):
    rng = random.Random(9)
    line = "the same line again\n"
    texts = [*ODD_TEXTS, *random_texts(5, 60, words=4, length=60), line * 9, "a b " * 40 + "c", "A a " * 5, *[" ".join(f"w{rng.randrange(99)}" for _ in range(70)) for _ in range(60)]]
    texts[ODD_TEXTS.index("x " * 5000)] = "x y " * 300
    ids = [None, *range(1, len(texts))]
    ids[-1] = ids[-2]
    docs = messy(spark, texts, ids)
    docs.repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    got = queries.op13_periods(spark, tmp_dir)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted((contract(i, t) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sum(r["n_runs"] > 0 for r in got.collect()) > 12


@pytest.mark.parametrize("rows", [0, 1])
def test_general_interface(spark, rows):
    out = periods.periodic_runs(messy(spark, ["z " + "a b c " * 5 + "d"]).limit(rows), id_col="digest").collect()
    assert [(r["digest"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out] == [("d", [(1, 15, 3)], "z a b c d")][:rows]

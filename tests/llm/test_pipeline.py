import hashlib
import re
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.common import ODD_TEXTS, messy, random_texts
from tripwire.llm import queries, secrets
from tripwire.llm.common import written


@pytest.fixture()
def tables(spark, tmp_dir):
    base = " ".join(f"b{k}" for k in range(60))
    leak = " ".join(f"q{k}" for k in range(20))
    texts = [*ODD_TEXTS, *random_texts(1, 40, words=300, length=60), base, base + " end", f"x {leak} y", f"{base[:150]} token=abcdefghijklmnop tail"]
    ids = [None, 1, 1, *range(3, len(texts))]
    docs = messy(spark, texts, ids)
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    return docs, tmp_dir, len(texts)


def test_every_stage_takes_effect(spark, tables):
    docs, sf_dir, n = tables
    read = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
        read[name] = docs
        if name != "bpe":
            assert docs.columns == tables[0].columns
    # Without labels every score is the smoothed share, a half: the classifier accepts none.
    assert read["quality"].count() == 0


def test_later_stages(spark, tables):
    docs, sf_dir, n = tables
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = written(stage(spark, out, sf_dir), "stage")
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert n - 4 not in texts or n - 3 not in texts  # one of two near copies
    assert n - 2 not in texts  # a leak
    assert "[SECRET]" in texts[n - 1] and "token" not in texts[n - 1]
    assert all(r["n_chars"] == len(r["text"]) for r in out.filter("text is not null").collect())
    last = corpus_pipeline.STAGES[4][1](spark, out, sf_dir)
    assert last.count() == out.count() and "ids_sha256" in last.columns


def test_near_copies_of_five_words_and_0_8(spark, tmp_dir):
    """A base, a copy at a similarity of 0.82 and one at 0.78, by sets of five-word shingles."""
    words = [f"b{k}" for k in range(104)]  # 100 shingles
    tail = [f"c{k}" for k in range(10)]
    near, far = words[:94] + tail, words[:91] + tail
    copies = {1: words, 2: near, 3: [f"f{w}" for w in words], 4: [f"f{w}" for w in far]}

    def likeness(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    assert 0.815 < likeness(copies[1], copies[2]) < 0.825 and 0.77 < likeness(copies[3], copies[4]) < 0.8
    docs = messy(spark, [" ".join(w) for w in copies.values()], list(copies))
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, tmp_dir).collect()) == [1, 3, 4]


def test_empty_tables_pass(spark, tables):
    docs, sf_dir, _ = tables
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, sf_dir), "stage")
    assert out.count() == 0


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] and names["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "bpe"]
    assert "pipeline" not in __spark_entry__.oracle_sql() and sys.modules["corpus_pipeline"] is corpus_pipeline


def _plain_near_copies(rows):
    """Ids that stay: the least of each component of five-word sets at 0.8; texts without words all stay."""
    from tests.llm.test_jaccard import brute

    ids = [r["doc_id"] for r in rows]
    components, _ = brute([r["text"] for r in rows], ids, 80, 5)
    return {i for i, _, least in components if i == least}


def _plain_clean(rows, items):
    """Ids without a window of ten item words (a shorter item is one window)."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall((t or "").encode().lower())

    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    return {r["doc_id"] for r in rows if not any(tuple(w[i : i + n]) in windows for w in [words(r["text"])] for n in sizes for i in range(len(w) - n + 1))}


def _plain_masked(text):
    """Secrets replaced: matches of every rule that are long enough, overlapping ones as one."""
    spans = []
    for rule in secrets.RULES:
        for m in regex.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                spans.append(m.span())
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at or at == 0:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_run_equals_plain_versions_of_its_stages(spark):
    """On the smallest tables, labels of both classes included: each stage against a plain version on that stage's own input."""
    sf = "/root/testdata/sf0.001"
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before.append(docs.select("doc_id", "text").collect())
        docs = written(stage(spark, docs, sf), "stage")
    last = docs.select("doc_id", "text").collect()
    good, copies, clean = before[1], before[2], before[3]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    by_class = {q: [i in kept for i, x in labels.items() if x == q] for q in (0, 1)}
    assert sum(by_class[1]) >= 0.9 * len(by_class[1]) and sum(by_class[0]) <= 0.1 * len(by_class[0]) and by_class[0] and by_class[1]
    assert {r["doc_id"] for r in copies} == _plain_near_copies(good)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == _plain_clean(copies, items)
    assert {r["doc_id"]: r["text"] for r in last} == {r["doc_id"]: _plain_masked(r["text"] or "") for r in clean}
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = {}
    for r in last:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50

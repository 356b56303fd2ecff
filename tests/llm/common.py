"""Fixtures and brute-force helpers."""

import random

SCHEMA = "doc_id long, text string, id string, digest string, raw_text int, score string, spans int, `rules` string, label_id int, n_chars long"


def messy(spark, texts, ids=None):
    """Documents with null and repeated rows and with columns named as the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "d", 1, "s", 2, "r", 3, len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD_TEXTS = [None, "", "   \t\n", "a", "A b", "the end", "the end", "é É ß Σ İ ﬁ", "x " * 5000, "\x00 \x1c \x85   y", "🙂‍🙂 你好", "{}[]%$ \\ </turn> ### $1"]


def random_texts(seed, n, words=30, length=40):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(words)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randrange(length))) for _ in range(n)]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        if words:
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

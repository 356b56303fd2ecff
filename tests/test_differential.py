"""T1/T2/T4/T5 against a short plain-Python restatement of ours, on random Unicode texts."""

import random
import re

from pyspark.sql import functions as F

from tripwire.operators import text as TX

NAMES = ["Alice", "Bob", "Éva"]
PHRASE = "James $1 Bond"  # '$' must not be read as a group reference
ALPHABET = list("abcxyz ÉéÜ漢字_09") + [" ", " ", "\n", ":", ".", "!", "?", ",", "\t"]


def rand_text(rng: random.Random) -> str:
    parts = []
    for _ in range(rng.randint(0, 25)):
        r = rng.random()
        if r < 0.2:
            parts.append(rng.choice(NAMES))
        elif r < 0.3:
            parts.append(rng.choice(["Q: ", "Bob: ", ". ", "!\n", "? "]))
        else:
            parts.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 6))))
    return "".join(parts)


def py_sentences(t):
    return [s for s in re.split(r"(?<=[.!?])[\t\n\x0b\f\r ]+", t) if s]


def py_ner(t, names, phrase):
    pat = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
    out, hit = [], False
    for s in py_sentences(t):
        m = re.match(r"(\w+: )?(.*)", s)
        prefix, main = m.group(1) or "", m.group(2)
        if pat.search(main):
            hit = True
        out.append(prefix + pat.sub(lambda _: phrase, main))
    return " ".join(out) if hit else t


def py_replace_spans(t, spans, phrase):
    res, cur = "", 0
    for a, b in sorted(spans):
        res += t[cur:a] + phrase
        cur = b
    return res + t[cur:]


def test_sentences_prefix_and_ner(spark):
    rng = random.Random(7)
    texts = [rand_text(rng) for _ in range(300)]
    gaz = [(n, "PERSON") for n in NAMES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(
        "i",
        TX.split_sentences("t").alias("s"),
        F.transform(TX.split_sentences("t"), lambda s: F.struct(TX.speaker_prefix(s), TX.sentence_main(s))).alias("pm"),
        TX.ner_replace("t", PHRASE, gaz).alias("ner"),
    ).collect()
    for r in sorted(got, key=lambda r: r.i):
        t = texts[r.i]
        assert list(r.s) == py_sentences(t)
        for (p, m), s in zip(r.pm, py_sentences(t)):
            mm = re.match(r"(\w+: )?(.*)", s)
            assert (p, m) == (mm.group(1) or "", mm.group(2))
        assert r.ner == py_ner(t, NAMES, PHRASE), t


def test_replace_spans_random(spark):
    rng = random.Random(11)
    rows = []
    for i in range(200):
        t = rand_text(rng)
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randint(0, 3))))
        spans = [(cuts[j], cuts[j + 1], "PERSON") for j in range(0, len(cuts) - 1, 2)]
        rng.shuffle(spans)
        rows.append((i, t, spans))
    df = spark.createDataFrame(rows, "i int, t string, sp " + TX.SPAN_TYPE.simpleString())
    got = df.select("i", TX.replace_spans("t", "sp", PHRASE).alias("o")).collect()
    for r in got:
        _, t, sp = rows[r.i]
        assert r.o == py_replace_spans(t, [(a, b) for a, b, _ in sp], PHRASE)


def test_annotate_matches_python(spark):
    rng = random.Random(3)
    texts = [rand_text(rng) for _ in range(200)]
    gaz = [(n, "PERSON") for n in NAMES] + [("Bob", "ORG"), ("xyz", "ORG")]
    pat = re.compile(r"(?<!\w)(?:Alice|Bob|Éva)(?!\w)")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", TX.annotate_entities("t", gaz).alias("sp")).collect()
    for r in got:
        t = texts[r.i]
        assert [(s.start, s.end) for s in r.sp] == [(m.start(), m.end()) for m in pat.finditer(t)]


def test_aho_annotator_agrees_with_regex():
    ann = TX.aho_annotator([(n, "PERSON") for n in NAMES])
    rng = random.Random(5)
    pat = re.compile(r"(?<!\w)(?:Alice|Bob|Éva)(?!\w)")
    texts = [rand_text(rng) for _ in range(200)]
    for t, spans in zip(texts, ann(texts)):
        assert [(a, b) for a, b, _ in spans] == [(m.start(), m.end()) for m in pat.finditer(t)]

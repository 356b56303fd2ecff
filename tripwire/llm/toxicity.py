"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train numpy classifiers under the
class-prior-corrected risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the
sigmoid loss; where the second term turns negative its gradient is reversed. Features
are words that occur in more toxic documents than their document frequency over the
whole corpus lets expect (log-likelihood ratio). The prior is a parameter, by default
the share of label 1 among the labels that may teach.

Bounds: about ``max_positive`` toxic and ``max_unlabelled`` other documents are fitted on,
chosen by a hash of the id; document frequencies cover all documents. Words are runs of
letters, digits and non-ASCII characters, A-Z lower-cased, of whole texts.

Defined results: null and empty texts have no words and get the model's base score; rows
without a usable label or with a null id teach nothing; repeated rows count as often as
they occur; with no toxic example every score is the smoothed prior; an empty table
gives an empty result; columns are selected by name, others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map, fresh, sample_by_hash, slices, text_bytes

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _words(text: bytes) -> set[bytes]:
    return set(_WORD.findall(text.lower()))


def _hashes(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in _words(text)], np.int64)


def _collected(rows: DataFrame) -> list[np.ndarray]:
    """Word hashes of each document of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([_hashes(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())], ["words"])

    out = [np.sort(np.frombuffer(w, np.int64)) for w in arrow_map(rows, run, "words binary").toArrow().column(0).to_pylist()]
    return sorted(out, key=lambda w: (len(w), w[:1].tobytes()))  # the order in which tasks end must not matter


def _frequencies(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]), return_counts=True)


def document_frequencies(texts: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each of these (bounded many) words occurs, and the number of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(set(words.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known, n = dict.fromkeys(shared.value, 0), {}, 0
        for b in slices(batches, 0):
            if len(known) > 300_000:
                known.clear()
            for t in b.column(0).to_pylist():
                n += 1
                for w in _words(t):
                    h = known.get(w)
                    if h is None:
                        h = xxhash.xxh3_64_intdigest(w) >> 1
                        h = known[w] = h if h in counts else -1
                    if h >= 0:
                        counts[h] += 1
        rows = [(-1, n), *((h, c) for h, c in counts.items() if c)]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64())], ["word", "n"])

    sums = {r["word"]: r["n"] for r in arrow_map(texts, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(h, 0) for h in words.tolist()], np.float64), sums.get(-1, 0)


def _ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of counts above expectation, else 0."""
    return np.where((seen > expected) & (seen >= 3), 2 * (seen * np.log(np.maximum(seen, 1) / expected) - (seen - expected)), 0)


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float


@dataclass
class ToxicityModel:
    words: np.ndarray  # sorted hashes
    classifiers: list[Classifier]

    def matrix(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(docs), len(self.words)), np.float32)
        if len(self.words):
            for i, w in enumerate(docs):
                at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
                out[i, at[self.words[at] == w]] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.mean([1 / (1 + np.exp(-np.clip(x @ c.weights + c.bias, -30, 30))) for c in self.classifiers], axis=0)


def train_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, start: np.ndarray, seed: int, steps: int = 100, rate: float = 0.03) -> Classifier:
    """Adam on minibatches of positive and unlabelled rows under the non-negative risk."""
    rng = np.random.default_rng(seed)
    params = [start.astype(np.float64).copy(), np.array([np.log(prior / (1 - prior)) - 1])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        p = xp[rng.integers(0, len(xp), min(len(xp), 2048))]
        u = xu[rng.integers(0, len(xu), min(len(xu), 8192))]
        sp, su = (1 / (1 + np.exp(-np.clip(x @ params[0] + params[1], -30, 30))) for x in (p, u))
        dp, du = sp * (1 - sp), su * (1 - su)
        gradient = [u.T @ du / len(u) - prior * (p.T @ dp) / len(p), np.array([du.mean() - prior * dp.mean()])]
        if su.mean() - prior * sp.mean() < 0:  # the risk of the negative part: never pushed below zero
            gradient = [-g for g in gradient]
        else:
            gradient = [g - prior * h for g, h in zip(gradient, (p.T @ dp / len(p), np.array([dp.mean()])), strict=True)]
        for q, m, v, g in zip(params, first, second, gradient, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(params[0], float(params[1][0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", prior: float | None = None,
        max_positive: int = 8_000, max_unlabelled: int = 20_000, max_words: int = 256, least_ratio: float = 10.0, bags: int = 3) -> ToxicityModel:
    """``learn`` (over the id) says which rows may teach, as toxic examples or as unlabelled text."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn)
    by_label = {r["label"]: r["n"] for r in usable.groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = by_label.get(1, 0), by_label.get(0, 0)
    share = prior if prior is not None else (toxic + 1) / (toxic + clean + 2)
    base = Classifier(np.zeros(0), float(np.log(share / (1 - share))))
    texts = docs.select(F.col(id_col).alias(id_col), text_bytes(F.col(text_col)).alias("text_bytes"))
    if not toxic:
        return ToxicityModel(np.zeros(0, np.int64), [base])
    # About max_positive ids: a broadcast of bounded size.
    ids = sample_by_hash(usable.filter(F.col(label_col) == 1), F.col(id_col), max_positive, toxic, 13).select(F.col(id_col).alias("label_id"))
    positive = _collected(texts.join(F.broadcast(ids), F.col(id_col) == F.col("label_id")).select("text_bytes"))
    may_teach = texts.filter(F.col(id_col).isNotNull() & learn)
    unlabelled = _collected(sample_by_hash(may_teach, F.col(id_col), max_unlabelled, may_teach.count(), 17).select("text_bytes"))
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(0, np.int64), [base])

    words, seen = _frequencies(positive)
    other, times = _frequencies(unlabelled)
    at = np.minimum(np.searchsorted(other, words), max(len(other) - 1, 0))
    rough = _ratio(seen, len(positive) * (np.where(other[at] == words, times[at], 0) + 0.5) / len(unlabelled)) if len(other) else seen * 0.0
    best = np.argsort(-rough, kind="stable")[: 8 * max_words]
    words, seen = words[best], seen[best]
    everywhere, n = document_frequencies(texts.select("text_bytes"), words)
    expected = len(positive) * (everywhere + 0.5) / max(n, 1)
    ratio = _ratio(seen, expected)
    best = np.argsort(-ratio, kind="stable")[:max_words]
    best = best[ratio[best] > least_ratio]
    best = best[np.argsort(words[best])]
    model = ToxicityModel(words[best], [])
    start = 2 * np.log((seen[best] + 0.5) / (expected[best] + 0.5))
    xp, xu = model.matrix(positive), model.matrix(unlabelled)
    model.classifiers = [train_nnpu(xp, xu, share, start, seed) for seed in range(bags)]
    return model


def score(docs: DataFrame, model: ToxicityModel, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the mean probability of the classifiers; the column takes the place of one with the same name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    (raw,) = fresh(docs, "raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        place = {h: i for i, h in enumerate(m.words.tolist())}
        for b in slices(batches, len(kept)):
            if len(known) > 300_000:
                known.clear()
            x = np.zeros((b.num_rows, len(place)), np.float32)
            for i, t in enumerate(b.column(len(kept)).to_pylist()):
                for w in _words(t):
                    k = known.get(w)
                    if k is None:
                        k = known[w] = place.get(xxhash.xxh3_64_intdigest(w) >> 1, -1)
                    if k >= 0:
                        x[i, k] = 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.probabilities(x), pa.float64())], [*kept, score_col])

    return arrow_map(docs.select(*kept, text_bytes(F.col(text_col)).alias(raw)), run, docs.select(*kept).schema.add(score_col, "double"))

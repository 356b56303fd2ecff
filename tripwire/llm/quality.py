"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every token (a run of letters and digits, or of other marks) falls in one of a fixed
number of buckets with a sparse random index vector. A bucket's context vector is the
sum of the index vectors of its neighbours over the whole corpus; each task sums its
part and sends rows of a fixed size. A document is the mean of its tokens' normalised
context vectors and index vectors, with the norm of each mean (high for repetitive text),
the share of repeated neighbours and the log of the length. A two-layer numpy network is
fitted on a bounded sample of labelled rows (``max_rows``; all rows below that), and its
temperature on a part held back from the sample.

Defined results: null and empty texts have a zero vector and get a score like any other;
rows without a usable label, or with a null id, teach nothing; repeated rows count as
often as they occur; with no labels, or one class only, every score is the (smoothed)
share of label 1; an empty table gives an empty result; columns are selected by name,
others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map, fresh, sample_by_hash, slices, text_bytes

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
_BUCKETS, _DIM, _ONES, _REACH = 8192, 64, 4, 2
_CHUNK = 32  # buckets in one row of a task's sums
_KEPT = 300_000
_PIECE = 2 << 20  # bytes of text cut into tokens at a time


class _Buckets(dict):
    def __missing__(self, token: bytes) -> int:
        b = self[token] = zlib.crc32(token) % _BUCKETS
        return b


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(7)
    places = rng.random((_BUCKETS, _DIM)).argsort(axis=1)[:, :_ONES]
    return places, rng.choice([-1.0, 1.0], (_BUCKETS, _ONES))


def _tokens(texts: list[bytes], known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' tokens in one array, and the number for each text."""
    if len(known) > _KEPT:
        known.clear()
    split = [_TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter((known[t] for s in split for t in s), np.int64, int(sizes.sum())), sizes


def context_vectors(texts: DataFrame) -> np.ndarray:
    """Normalised context vectors of the buckets, from all of ``texts`` (one binary column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        total, known = np.zeros(_BUCKETS * _DIM), _Buckets()
        for b in slices(batches, 0, _PIECE):
            at, sizes = _tokens(b.column(0).to_pylist(), known)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for o in range(1, _REACH + 1):
                near = doc[:-o] == doc[o:]
                left, right = at[:-o][near], at[o:][near]
                for word, other in ((left, right), (right, left)):
                    for k in range(_ONES):
                        total += np.bincount(word * _DIM + places[other, k], weights=signs[other, k], minlength=_BUCKETS * _DIM)
        rows = [(k, c) for k, c in enumerate(total.reshape(-1, _CHUNK * _DIM)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c.astype(np.int32).tobytes() for _, c in rows], pa.binary())], ["chunk", "sums"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK * _DIM, np.int64)
        for c in rows.column("sums").to_pylist():
            total += np.frombuffer(c, np.int32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((_BUCKETS // _CHUNK, _CHUNK * _DIM))
    sums = arrow_map(texts, run, "chunk int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, sums binary")
    for row in sums.collect():
        out[row["chunk"]] = np.frombuffer(row["sums"], np.int64)
    out = out.reshape(_BUCKETS, _DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Context and index vector of each bucket side by side."""
    places, signs = _index_vectors()
    index = np.zeros((_BUCKETS, _DIM), np.float32)
    index[np.arange(_BUCKETS)[:, None], places] = signs / np.sqrt(_ONES)
    return np.hstack([context, index])


def pooled(texts: list[bytes], vectors: np.ndarray, known: _Buckets) -> np.ndarray:
    """A row of features for each text."""
    at, sizes = _tokens(texts, known)
    out = np.zeros((len(texts), vectors.shape[1] + 4), np.float32)
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        if a < b:
            mine = at[a:b]
            buckets, times = np.unique(mine, return_counts=True)
            mean = (times / (b - a)).astype(np.float32) @ vectors[buckets]
            out[i, :-4] = mean
            out[i, -4:] = np.linalg.norm(mean[:_DIM]), np.linalg.norm(mean[_DIM:]), np.mean(mine[1:] == mine[:-1]) if b - a > 1 else 0, np.log1p(b - a)
    return out


@dataclass
class Network:
    """Standardised input, one hidden tanh layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(inputs: int, share: float) -> Network:
    return Network(np.zeros(inputs), np.ones(inputs), np.zeros((inputs, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Network:
    """Adam on the log loss; then the temperature with the least log loss on a fifth held back."""
    if len(y) == 0 or y.min() == y.max():
        return constant(x.shape[1], (y.sum() + 1) / (len(y) + 2))
    rng = np.random.default_rng(seed)
    back = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~back)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.2, hidden), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, 3000 * batch // max(len(fit), 1)) if len(fit) < 10_000 else epochs // 2):
        rng.shuffle(fit)
        for s in range(0, len(fit), batch):
            j = fit[s : s + batch]
            h = np.tanh(z[j] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[j]) / len(j)
            gh = np.outer(g, params[2]) * (1 - h * h)
            step += 1
            for p, m, v, d in zip(params, first, second, (z[j].T @ gh + decay * params[0], gh.sum(0), h.T @ g, g.sum(keepdims=True)), strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if back.any():
        logit, t = net.logits(x[back]), np.geomspace(0.25, 16, 61)
        loss = [np.mean(np.logaddexp(0, np.where(y[back] == 1, -1, 1) * logit / k)) for k in t]
        net.temperature = float(t[int(np.argmin(loss))])
    return net


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """``(text, label)`` of about ``max_rows`` rows of ``labels`` that may teach. The sample of ids is
    bounded, so it is broadcast; whole texts are read only for it."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn)
    ids = sample_by_hash(usable, F.col(id_col), max_rows, usable.count(), 11).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("text"))
    return rows.join(F.broadcast(ids), F.col("id") == F.col("label_id")).select("text", "label")


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> QualityModel:
    """Word vectors from all texts; the network from the rows of ``labels`` where ``learn`` holds."""
    vectors = word_vectors(context_vectors(docs.select(text_bytes(F.col(text_col)).alias("text"))))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for b in slices(batches, 0, _PIECE):
            x = pooled(b.column(0).to_pylist(), shared.value, known)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], ["x", "label"])

    rows = arrow_map(labelled(docs, labels, label_col, learn, id_col, text_col, max_rows), run, "x binary, label int").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, vectors.shape[1] + 4).astype(np.float64)
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[-3:], y))  # the order in which tasks end must not matter
    return QualityModel(vectors, train(x[order], y[order]))


def score(docs: DataFrame, model: QualityModel, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1; the column takes the place of one with the same name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    (raw,) = fresh(docs, "raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for b in slices(batches, len(kept), _PIECE):
            x = pooled(b.column(len(kept)).to_pylist(), shared.value.vectors, known)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.network.probabilities(x), pa.float64())], [*kept, score_col])

    return arrow_map(docs.select(*kept, text_bytes(F.col(text_col)).alias(raw)), run, docs.select(*kept).schema.add(score_col, "double"))

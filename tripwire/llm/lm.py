"""Language-model scoring: a unigram base and a log-bilinear neural model.

Words are counted over all training texts. The model's classes are the most frequent words,
the end of a text, and for other words their last byte; a class is predicted from the two
classes before it by a log-bilinear network, trained in numpy with noise-contrastive
estimation on every training token: each task makes a pass over its texts from one
common start, and the results are averaged, weighted by tokens. Probabilities are
normalised by batched matrix products over all classes, once for each context. A word
outside the vocabulary then has its share of its class, (count + 1) / (tokens + types + 1).

Counts of the most frequent words (a bounded number) are looked up inside the tasks;
other words of a text are joined with the count table, so no vocabulary is ever held
whole.

Defined results: null texts count as empty and have the end token only; repeated rows
are scored alike and count as often as they occur; without training rows the counts are
zero and the model starts from uniform classes; an empty table gives an empty result;
columns are selected by name, others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map, slices, text_bytes, written

#: Words with counts inside the tasks: at most this many, some 10 MB in a task.
MAX_LOCAL = 200_000
_FLUSH = 400_000  # distinct words that a counting task holds
_TRAIN_TOKENS = 1 << 19  # tokens that a training task holds
_PIECE = 2 << 20  # bytes of text read at a time
_ROWS = 1 << 15  # tokens scored at a time


def _tokens(text: bytes) -> list[bytes]:
    """Words, then the end as the empty word."""
    return [*text.lower().split(), b""]


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over all of ``texts`` (one binary column); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in slices(batches, 0):
            for t in b.column(0).to_pylist():
                counts.update(_tokens(t))
            if len(counts) > _FLUSH:
                yield rows()
                counts.clear()
        yield rows()

    return written(arrow_map(texts, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    """Frequent words with counts; the first ``size`` of them are classes of their own."""

    words: list[bytes]
    counts: np.ndarray
    size: int
    tokens: int
    types: int
    rest_tokens: np.ndarray  # of the words outside the vocabulary, by last byte
    rest_types: np.ndarray

    @property
    def classes(self) -> int:
        return self.size + 256 + 1

    @property
    def end(self) -> int:
        return self.size + 256

    @property
    def start(self) -> int:
        """The class before a text's first word: a context only."""
        return self.classes

    def class_counts(self) -> np.ndarray:
        ends = self.tokens - self.counts[: self.size].sum() - self.rest_tokens.sum()
        return np.r_[self.counts[: self.size], self.rest_tokens, ends].astype(np.float64)


def vocabulary(counts: DataFrame, size: int) -> Vocabulary:
    """All figures from the count table. Words come to the driver down to the count at which they
    are still at most MAX_LOCAL."""
    last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
    by_byte = counts.filter("length(word) > 0").groupBy(last.alias("last")).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("types")).collect()
    step = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(step.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for level, n in levels:
        if kept + n > MAX_LOCAL:
            break
        kept, least = kept + n, level
    frequent = [] if least is None else [(bytes(r["word"]), r["c"]) for r in counts.filter((step >= least) & (F.length("word") > 0)).collect()]
    frequent.sort(key=lambda x: (-x[1], x[0]))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    rest_tokens, rest_types = np.zeros(256), np.zeros(256)
    for r in by_byte:
        rest_tokens[r["last"]], rest_types[r["last"]] = r["tokens"], r["types"]
    size = min(size, len(frequent))
    for word, c in frequent[:size]:
        rest_tokens[word[-1]] -= c
        rest_types[word[-1]] -= 1
    return Vocabulary([w for w, _ in frequent], np.array([c for _, c in frequent], np.float64), size, int(total["n"] or 0), int(total["v"]), rest_tokens, rest_types)


class _Places(dict):
    """Place of a frequent word; -1 - last byte of any other."""

    def __missing__(self, word: bytes) -> int:
        return -1 - word[-1]


class _Reader:
    """Tokens of texts as places among the frequent words and as classes."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.places = _Places((w, k) for k, w in enumerate(v.words))
        self.places[b""] = len(v.words)
        last = np.array([w[-1] for w in v.words], np.int64)
        self.class_of = np.r_[np.where(np.arange(len(last)) < v.size, np.arange(len(last)), v.size + last), v.end]

    def read(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Words, sizes and, for all texts in one array, places."""
        split = [_tokens(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        get = self.places.__getitem__
        return split, sizes, np.fromiter((get(w) for words in split for w in words), np.int64, int(sizes.sum()))

    def classes(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.class_of[np.maximum(places, 0)], self.v.size - 1 - places)

    def contexts(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two tokens before each; the start class before a text."""
        first = np.zeros(len(classes) + 1, bool)
        first[np.cumsum(sizes) - sizes] = True
        first = first[:-1]
        one = np.where(first, self.v.start, np.r_[0, classes[:-1]])
        second = np.r_[False, first[:-1]]
        two = np.where(first | second, self.v.start, np.r_[0, 0, classes[:-2]][: len(classes)])
        return one, two


@dataclass
class LogBilinear:
    """Score of class w after contexts (a, b): (r_a * c1 + r_b * c2) . q_w + bias_w."""

    r: np.ndarray
    q: np.ndarray
    bias: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    normalisers: np.ndarray | None = field(default=None, repr=False)

    def hidden(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.c1 + self.r[two] * self.c2

    def log_probabilities(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logs, normalised over all classes; a context's sum is kept once it is known."""
        n = len(self.r)
        if self.normalisers is None:
            self.normalisers = np.full(n * n, np.nan, np.float32)
        key = one * n + two
        new = np.unique(key[np.isnan(self.normalisers[key])])
        for s in range(0, len(new), 2048):
            part = new[s : s + 2048]
            logits = self.hidden(part // n, part % n) @ self.q.T + self.bias
            top = logits.max(axis=1)
            self.normalisers[part] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        out = self.bias[words] - self.normalisers[key]
        for s in range(0, len(words), _ROWS):
            at = slice(s, s + _ROWS)
            out[at] += np.einsum("ij,ij->i", self.hidden(one[at], two[at]), self.q[words[at]])
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.bias[:, None], self.c1[None], self.c2[None]]


def initial(v: Vocabulary, dim: int, seed: int = 3) -> LogBilinear:
    rng = np.random.default_rng(seed)
    p = v.class_counts() + 1
    return LogBilinear(rng.normal(0, 0.5, (v.classes + 1, dim)).astype(np.float32), np.zeros((v.classes, dim), np.float32),
                       np.log(p / p.sum()).astype(np.float32), np.ones(dim, np.float32), np.ones(dim, np.float32))


def _rows_added(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(values[order], first, axis=0)


class _Trainer:
    """Adagrad on the noise-contrastive loss, with noise classes shared by a minibatch."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, k: int, rate: float, seed: int) -> None:
        self.m, self.k, self.rate, self.rng = model, k, rate, np.random.default_rng(seed)
        self.noise, self.log_kp = noise, np.log(k * noise).astype(np.float32)
        self.cumulated = np.cumsum(noise)
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in (model.r, model.q, model.bias, model.c1, model.c2)]

    def _step(self, x: np.ndarray, s: np.ndarray, at: np.ndarray | slice, g: np.ndarray) -> None:
        s[at] += g * g
        x[at] -= self.rate * g / np.sqrt(s[at])

    def step(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.m, np.float32(1 / len(words))
        false = np.minimum(np.searchsorted(self.cumulated, self.rng.random(self.k) * self.cumulated[-1]), len(self.noise) - 1)
        r1, r2, q = m.r[one], m.r[two], m.q[words]
        h = r1 * m.c1 + r2 * m.c2
        qf = m.q[false]
        true_g = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", h, q) + m.bias[words] - self.log_kp[words]))) - 1
        false_g = 1 / (1 + np.exp(-(h @ qf.T + m.bias[false] - self.log_kp[false])))
        dh = true_g[:, None] * q + false_g @ qf
        at, dq = _rows_added(np.r_[words, false], np.r_[true_g[:, None] * h, false_g.T @ h] * n)
        _, db = _rows_added(np.r_[words, false], np.r_[true_g, false_g.sum(0)] * n)
        c1, c2 = m.c1.copy(), m.c2.copy()
        self._step(m.q, self.squares[1], at, dq)
        self._step(m.bias, self.squares[2], at, db)
        self._step(m.c1, self.squares[3], slice(None), (dh * r1).sum(0) * n)
        self._step(m.c2, self.squares[4], slice(None), (dh * r2).sum(0) * n)
        at, dr = _rows_added(np.r_[one, two], np.r_[dh * c1, dh * c2] * n)
        self._step(m.r, self.squares[0], at, dr)


def train(texts: DataFrame, v: Vocabulary, dim: int = 32, noise: int = 64, batch: int = 4096, rate: float = 0.1) -> LogBilinear:
    """One pass over all of ``texts`` in every task at once; the averaged model. What tasks send is
    of the size of the model."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        reader, model = _Reader(v), initial(v, dim)
        p = v.class_counts() + 1
        trainer = _Trainer(model, p / p.sum(), noise, rate, 5)
        rng, held, seen = np.random.default_rng(9), [], 0

        def learn() -> None:
            words, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            order = rng.permutation(len(words))
            for s in range(0, len(order), batch):
                j = order[s : s + batch]
                trainer.step(words[j], one[j], two[j])
            held.clear()

        for b in slices(batches, 0, _PIECE):
            _, sizes, places = reader.read(b.column(0).to_pylist())
            classes = reader.classes(places)
            held.append((classes, *reader.contexts(classes, sizes)))
            seen += len(classes)
            if sum(len(h[0]) for h in held) > _TRAIN_TOKENS:
                learn()
        if held:
            learn()
        if seen:
            rows = [(k, i, x[i]) for k, x in enumerate(model.parts()) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in rows], pa.int32()), pa.array([i for _, i, _ in rows], pa.int32()), pa.array([seen] * len(rows), pa.int64()),
                 pa.array([x.astype(np.float32).tobytes() for _, _, x in rows], pa.binary())], ["part", "row", "n", "x"])

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy().astype(np.float64)
        x = np.stack([np.frombuffer(x, np.float32) for x in rows.column("x").to_pylist()])
        order = np.lexsort((x[:, 0], n))
        x = (n[order] / n.sum()) @ x[order]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([key[1].as_py()], pa.int32()), "x": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

    model = initial(v, dim)
    parts = model.parts()
    for row in arrow_map(texts, run, "part int, row int, n long, x binary").groupBy("part", "row").applyInArrow(mean, "part int, row int, x binary").collect():
        parts[row["part"]][row["row"]] = np.frombuffer(row["x"], np.float32)
    return LogBilinear(parts[0], parts[1], parts[2][:, 0], parts[3][0], parts[4][0])


_LOADED: dict = {}


def _loaded(shared) -> tuple[_Reader, LogBilinear]:
    """Reader and model of a broadcast, one for each Python worker, so that context sums are kept between tasks."""
    if shared.value["name"] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value["name"]] = _Reader(shared.value["vocabulary"]), shared.value["model"]
    return _LOADED[shared.value["name"]]


def score(docs: DataFrame, v: Vocabulary, counts: DataFrame, model: LogBilinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10)."""
    import uuid

    shared = docs.sparkSession.sparkContext.broadcast({"name": uuid.uuid4().hex, "vocabulary": v, "model": model})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = _loaded(shared)
        v = reader.v
        # What a place adds to either score but for the class's own probability.
        log_c = np.r_[np.log10(v.counts + 1), np.log10(v.class_counts()[-1] + 1)]
        share = -np.log10(v.rest_tokens + v.rest_types + 1)
        number = TaskContext.get().partitionId() << 40
        for b in slices(batches, 1, _PIECE):
            words, sizes, places = reader.read(b.column(1).to_pylist())
            classes = reader.classes(places)
            one, two = reader.contexts(classes, sizes)
            starts = np.cumsum(sizes) - sizes
            local = places >= 0
            counted = np.where(local, log_c[np.maximum(places, 0)], 0.0)
            own = (classes < v.size) | (classes == v.end)
            neural = model.log_probabilities(classes, one, two) / np.log(10)
            neural = neural + np.where(own, 0.0, counted + share[np.where(own, 0, classes - v.size)])
            of = np.repeat(np.arange(len(sizes)), sizes)
            rare = [Counter() for _ in words]
            for t in np.flatnonzero(~local):
                rare[of[t]][words[of[t]][t - starts[of[t]]]] += 1
            known = np.where(places == len(v.words), v.class_counts()[-1] > 0, local)
            ids = np.arange(number, number + len(sizes))
            number += len(sizes)
            none = pa.nulls(len(sizes), pa.binary())
            sums = [np.add.reduceat(x, starts) if len(x) else np.zeros(0) for x in (known.astype(np.int64), counted, neural)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), b.column(0), none, pa.array(sizes), *map(pa.array, sums)], ["row", "id", "word", "n", "known", "counted", "neural"])
            flat = [(int(i), w, n) for i, c in zip(ids, rare, strict=True) for w, n in c.items()]
            if flat:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in flat]), pa.nulls(len(flat), b.schema.field(0).type), pa.array([x[1] for x in flat], pa.binary()), pa.array([x[2] for x in flat]),
                     *(pa.nulls(len(flat), t) for t in (pa.int64(), pa.float64(), pa.float64()))], ["row", "id", "word", "n", "known", "counted", "neural"])

    texts = docs.select(F.col(id_col).alias("id"), text_bytes(F.col(text_col)).alias("raw_text"))
    rows = written(arrow_map(texts, run, f"row long, id {kind}, word binary, n long, known long, counted double, neural double"), "scores")
    rare = rows.filter("word is not null").select("row", "word", "n").join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    more_known, added = F.coalesce("more_known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    unit = float(np.log10(v.tokens + 1 * (v.types + 1)))
    return rows.filter("word is null").join(more, "row", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), (F.col("known") + more_known).alias("n_known"),
        (F.col("counted") + added - F.col("n") * unit).alias("base_score"), (F.col("neural") + added).alias("score"))


def fit(docs: DataFrame, learn: Column, size: int = 1024, text_col: str = "text") -> tuple[Vocabulary, DataFrame, LogBilinear]:
    """Counts of, and a model trained on, every row of ``docs`` where ``learn`` holds."""
    texts = docs.filter(learn).select(text_bytes(F.col(text_col)).alias("raw_text"))
    counts = count_words(texts)
    v = vocabulary(counts, size)
    return v, counts, train(texts, v)

"""BPE encoding and decoding over a pair occurrence index.

The distinct words of a piece of a partition stand in one flat symbol array with
links to the left and right neighbour. An index maps each mergeable pair to all
its positions; a heap gives the active ranks in ascending order. Applying a rank
merges all its positions at once and adds the new neighbour pairs to the lists
of their ranks. Work is per distinct word; texts are assembled from the words'
ids, and decoded from the ids alone.

Null texts count as empty (no ids, decoded as the empty string); repeated rows,
ties of ids and extra columns do not matter, as every row is handled by itself;
an empty table gives an empty result. Whole texts are encoded: a text longer
than a piece is a piece of its own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tripwire.llm.common import arrow_map, fresh, slices, text_bytes

#: White space as the vocabulary's own pre-tokenizer sees it (Unicode White_Space).
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = regex.compile(rf"{_SUFFIXES}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(rf"{_SUFFIXES}|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+")
#: Distinct words kept between the pieces of a partition.
CACHE_WORDS = 400_000
#: Bytes of text encoded at a time: its words are Python strings meanwhile, some ten times as large.
_PIECE = 2 << 20


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndexBPE:
    """Word-end BPE (lower-cased words, ``</w>`` on the last symbol) read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) << 32 | self.right
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank_of]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        self.token = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self._reset()

    def _reset(self) -> None:
        self.index = {t: k for k, t in enumerate(self.special)}
        self.flat = [np.array([*self.special.values()], np.int32)]
        self.lengths = [np.ones(len(self.special), np.int64)]

    # words ------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token's string is one."""
        if "<|" in text:
            parts = self.special_at.split(text)
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        # Lower-casing is by single character: no final form of sigma.
        return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        tok = self.inner[data]
        last = ends[sizes > 0] - 1
        tok[last] = self.final[data[last]]
        n = len(tok)
        nxt = np.arange(1, n + 1)
        nxt[last] = -1
        prv = np.arange(-1, n - 1)
        prv[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            if not len(at):
                return
            ranks = self._ranks(tok[at], tok[nxt[at]])
            keep = ranks >= 0
            at, ranks = at[keep], ranks[keep]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            for a, b, r in zip(firsts, [*firsts[1:], len(at)], ranks[firsts].tolist(), strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(active, r)

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            a, b = self.left[r], self.right[r]
            at = at[(tok[at] == a) & (nxt[at] >= 0)]
            at = at[tok[nxt[at]] == b]
            if len(found) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:  # of overlapping pairs the left one merges
                chained = np.r_[False, nxt[at[:-1]] == at[1:]]
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = self.made[r]
            tok[gone] = -1
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            add(np.concatenate([before[before >= 0], at[after >= 0]]))
        kept = tok >= 0
        counts = np.add.reduceat(np.r_[kept, False], np.r_[ends - sizes, n], dtype=np.int64)[: len(words)] if n else np.zeros(len(words), np.int64)
        return tok[kept], np.where(sizes > 0, counts, 0)

    # texts ------------------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        split = [self.words(t) for t in texts]
        index = self.index
        new = list(dict.fromkeys(w for words in split for w in words if w not in index))
        if new:
            ids, counts = self.merge([w.encode() for w in new])
            index.update(zip(new, range(len(index), len(index) + len(new)), strict=True))
            self.flat.append(ids)
            self.lengths.append(counts)
        flat = self.flat[0] if len(self.flat) == 1 else np.concatenate(self.flat)
        lengths = self.lengths[0] if len(self.lengths) == 1 else np.concatenate(self.lengths)
        self.flat, self.lengths = [flat], [lengths]
        starts = np.cumsum(lengths) - lengths
        out = []
        for words in split:
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            n = lengths[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(starts[at] - (ends - n), n) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a blank (the file names no decoder); special tokens stay."""
        token = self.token
        return " ".join([token[i] for i in ids.tolist()])


@functools.lru_cache(maxsize=2)
def load(path: str) -> PairIndexBPE:
    """One model for each Python worker and file."""
    return PairIndexBPE(path)


def _texts(batch: pa.RecordBatch, column: int) -> list[str]:
    return [b.decode("utf-8", "replace") for b in batch.column(column).to_pylist()]


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array column of ids; the column takes the place of one with the same name."""
    (raw,) = fresh(df, "raw_text")
    kept = [c for c in df.columns if c.lower() != ids_col.lower()]
    schema = df.select(*kept).schema.add(ids_col, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in slices(batches, len(kept), _PIECE):
            ids = model.encode_batch(_texts(b, len(kept)))
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, values)], [*kept, ids_col])
        model._reset()

    return arrow_map(df.select(*kept, text_bytes(F.col(text_col)).alias(raw)), run, schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of an array column of ids (null: empty)."""
    kept = [c for c in df.columns if c.lower() != text_col.lower()]
    schema = df.select(*kept).schema.add(text_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            texts = [model.decode(np.asarray(x or [], np.int64)) for x in b.column(kept.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*kept, text_col])

    return arrow_map(df.select(*kept), run, schema)


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, digest of the ids (little-endian unsigned 32 bit) and digest
    of the text decoded from them. Ids and decoded text stay inside the task."""
    schema = df.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in slices(batches, 1, _PIECE):
            ids = model.encode_batch(_texts(b, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        model._reset()  # the worker lives on: its next task may be of another stage

    (raw,) = fresh(df, "raw_text")
    return arrow_map(df.select(id_col, text_bytes(F.col(text_col)).alias(raw)), run, schema)

"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole: ``### role: text</turn>`` and a line end per turn.
Inside roles and texts a backslash stands before every backslash and control string,
so the rendering can be parsed back exactly. It is encoded once, with offsets; the
assistant texts' spans are intersected with the sorted token spans by binary search.

Rows of a conversation are put side by side by a shuffle on its id and sorted by turn;
a task holds one batch of conversations at a time. Defined results: null texts and roles
are empty; turns with equal numbers are ordered by role, then text; repeated rows are
turns of their own; rows with a null id form one conversation; an empty table gives an
empty result; columns are selected by name, others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import arrow_map

_START, _MIDDLE, _END = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|:|###|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Characters of rendered conversations encoded at a time; a longer conversation is a batch of its own.
_BATCH_CHARS = 1 << 17


def escape(text: str, marks: re.Pattern = _TEXT) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The conversation as one string and (role, start, end) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = _START + escape(role, _ROLE) + _MIDDLE, escape(text)
        at += len(head)
        spans.append((role, at, at + len(body)))
        at += len(body) + len(_END)
        parts += [head, body, _END]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def covered(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens meet a span, and the characters they cover inside the spans as maximal stretches."""
    mask, stretches = np.zeros(len(starts), bool), []
    for a, b in spans:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if i >= j or a >= b:
            continue
        mask[i:j] = True
        s, e = np.maximum(starts[i:j], a), np.maximum.accumulate(np.minimum(ends[i:j], b))
        cuts = np.flatnonzero(s[1:] > e[:-1])
        stretches += zip(s[np.r_[0, cuts + 1]].tolist(), e[np.r_[cuts, len(e) - 1]].tolist(), strict=True)
    return mask, stretches


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    # Tasks are the unit of parallelism; threads of the library's own would each keep memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # such strings in a text are ordinary text
    t.no_truncation()
    t.no_padding()
    return t


def format_chats(turns: DataFrame, path: str, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: its id, ``formatted``, ``ids``, ``loss_mask`` (per token) and ``loss_spans``
    (characters under the mask that belong to the texts of ``loss_role``)."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"{conv_col} {rows.schema['conv'].dataType.simpleString()}, formatted string, ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, turns_ = None, []
        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if turns_ and conv != now:
                    yield now, turns_
                    turns_ = []
                now = conv
                turns_.append((role, text))
        if turns_:
            yield now, turns_

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None

        def encoded() -> pa.RecordBatch:
            out = []
            for conv, text, spans in held:
                enc = _tokenizer(path).encode(text, add_special_tokens=False)
                offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
                mask, stretches = covered(offsets[:, 0], offsets[:, 1], [(a, b) for role, a, b in spans if role == loss_role])
                out.append((conv, text, enc.ids, mask.tolist(), [{"start": a, "end": b} for a, b in stretches]))
            types = [kind, pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(span)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], [conv_col, "formatted", "ids", "loss_mask", "loss_spans"])

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for conv, turns_ in conversations(seen()):
            text, spans = render(turns_)
            held.append((conv, text, spans))
            size += len(text)
            if size >= _BATCH_CHARS:
                yield encoded()
                held, size = [], 0
        if held:
            yield encoded()

    return arrow_map(rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"), run, schema)


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted output holds: turns, and the text under the mask, as counts and digests."""
    rows = chats.select(conv_col, "formatted", "loss_spans")
    schema = rows.select(conv_col).schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add(
        "loss_sha256", "string").add("formatted_chars", "long")

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
                out.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(types)]], schema.names)

    return arrow_map(rows, run, schema)

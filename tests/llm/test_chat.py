import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tripwire.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = st.lists(st.sampled_from(["\\", "###", "### ", "#", "</turn>", "</turn>\n", "<", ":", ": ", "\n", "a", "é🙂", "<|endoftext|>"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, PARTS), max_size=5))
def test_rendering_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [(r, chat.unescape(text[a:b])) for r, a, b in spans] == turns


def test_parse_rejects_other_text():
    with pytest.raises(ValueError):
        chat.parse("### user: hello")


def test_masks_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 12))
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        at = sorted(rng.sample(range(60), 4))
        spans = [(at[0], at[1]), (at[2], at[3])]
        mask, stretches = chat.covered(starts, ends, spans)
        assert mask.tolist() == [any(s < b and e > a for a, b in spans) for s, e in zip(starts, ends, strict=True)]
        inside = {c for a, b in spans for c in range(a, b) if cuts[0] <= c < cuts[-1]}
        assert {c for a, b in stretches for c in range(a, b)} == inside


def test_output_read_back(spark):
    rows = [(1, 0, "system", None), (1, 2, "assistant", "é🙂 </turn> \\"), (1, 1, "user", "hi ### x"), (2, 0, "assistant", ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"),
            (3, 0, None, "x" * 50000), (None, 0, "assistant", "n"), (None, 1, "user", ""), (4, None, "assistant", "first"), (4, 0, "assistant", "second"), (5, 0, "user", "u"), (5, 0, "user", "u")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(turns, PATH)
    assert out.columns == ["conv_id", "formatted", "ids", "loss_mask", "loss_spans"]
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in (1, 2, 3, None, 4, 5):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == digest("".join(f"{r}\n{x}\n" for _, _, r, x in mine))
        assert got[conv]["loss_sha256"] == digest(loss)
    for r in out.collect():
        assert len(r["ids"]) == len(r["loss_mask"])
    assert chat.read_back(chat.format_chats(turns.limit(0), PATH)).count() == 0

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import ODD_TEXTS, messy, random_texts
from tripwire.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_decoding_equal_the_library(library):
    rng = random.Random(1)
    signs = [*"aaab  \n\t'sdtvem!?12½²ⅣéÉΣσςİıK_-ßẞﬁ你好🙂ǅ\x1c\x85 ‍\x00", "́", "<|endoftext|>", "<|startoftext|>", "<|", "aaaa", "'ll"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    model = bpe.PairIndexBPE(PATH)
    ids = model.encode_batch(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ids] == expected
    assert [model.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in expected]


def test_cache_reset_changes_nothing(monkeypatch):
    texts = random_texts(2, 60, words=500)
    whole = bpe.PairIndexBPE(PATH).encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    model = bpe.PairIndexBPE(PATH)
    pieces = [x for t in texts for x in model.encode_batch([t])]
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))


def test_round_trip_of_messy_rows(spark, library):
    out = {}
    for r in bpe.bpe_round_trip(messy(spark, ODD_TEXTS), PATH).collect():
        out[r["doc_id"]] = r
    assert len(out) == len(ODD_TEXTS)
    for i, t in enumerate(ODD_TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_keep_columns(spark, library):
    docs = messy(spark, ODD_TEXTS, [None, 1, 1, *range(3, len(ODD_TEXTS))])
    ids = bpe.bpe_encode(docs, PATH)
    assert ids.columns == [*docs.columns, "ids"]
    back = bpe.bpe_decode(ids, PATH)
    got = {(r["doc_id"], r["text"]): r["decoded"] for r in back.collect()}
    assert got[(4, "A b")] == "a</w> b</w>" and got[(None, None)] == ""
    assert bpe.bpe_round_trip(docs.limit(0), PATH).count() == 0

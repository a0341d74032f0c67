import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm import cases
from voicelane.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(MODEL)


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_random_texts_encode_as_the_library_does(codec):
    rng = random.Random(1)
    letters = "abcdefghij  ▁▁ \n\t.,<>s/é日本ñ한🙂\x00ﬁABthein123()*"
    for _ in range(5_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        expected = codec.model.encode(text, add_bos=True, add_eos=True)
        assert ids(codec.encode(text, True, True)) == expected, text


def test_long_words_are_linear(codec):
    text = "a" * 50_000 + "thein" * 10_000 + " " * 5_000
    assert ids(codec.encode(text)) == codec.model.encode(text)


def test_backtracking_steps_back(codec):
    """Greedy longest matches alone would give other pieces for some words."""

    def greedy(word):
        out = []
        while word:
            size = max(k for k in range(1, len(word) + 1) if k == 1 or word[:k] in codec.score)
            out.append(word[:size])
            word = word[size:]
        return out

    words = ["▁" + a + b for a in ("there", "nation", "under", "sing") for b in ("tions", "erin", "thes", "ation")]
    assert any(greedy(w) != codec.pieces(w) for w in words)
    assert all(codec.pieces(w) == codec.merged(w) for w in words)


def test_store_may_overflow(codec, monkeypatch):
    monkeypatch.setattr(pieces, "HELD", 5)
    held = pieces.Held(lambda key: key.upper())
    words = [f"w{i % 9}" for i in range(100)]
    assert [held[w] for w in words] == [w.upper() for w in words]
    assert len(held) <= 6


def test_documents(spark, codec):
    docs = cases.documents(spark, extra={"ids": "1", "DECODED": "'x'", "kept_as_is": "doc_id"})
    rows = pieces.encode(docs, MODEL).collect()
    assert len(rows) == len(cases.DOCS)
    for row in rows:
        text = row["text"] or ""
        expected = codec.model.encode(text, add_bos=True, add_eos=True)
        assert ids(row["ids"]) == expected and row["n_tokens"] == len(expected)
        assert row["decoded"] == codec.model.decode(expected)
        assert row["kept_as_is"] == row["doc_id"]
    again = pieces.decode(pieces.encode(docs, MODEL, decoded=False), MODEL).collect()
    assert sorted(r["decoded"] for r in again) == sorted(r["decoded"] for r in rows)


def test_no_documents(spark):
    none = pieces.encode(cases.documents(spark, []), MODEL)
    assert none.collect() == [] and {"ids", "n_tokens", "decoded"} <= set(none.columns)

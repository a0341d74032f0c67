import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from voicelane.llm import common, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("count", [0, 1, 7, 64, 65, 1_000])
def test_planes_round_trip(kind, count):
    ids = np.random.default_rng(count).integers(0, 1 << 32, count, dtype=np.uint64).astype("<u4")
    parts = token_files.planes(ids, kind)
    assert len(parts) == (4 if kind == "byte" else 32)
    assert (token_files.joined(parts, count) == ids).all()


def one_file(kind, docs, block=100):
    stream = io.BytesIO()
    writer = token_files.Writer(stream, kind, block)
    for doc, ids in docs:
        writer.add(doc, np.array(ids, dtype="<u4").tobytes())
    writer.close()
    return stream


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip(kind):
    rng = np.random.default_rng(3)
    docs = [(d, rng.integers(0, 49_408, n).tolist()) for d, n in enumerate([0, 5, 100, 1, 0, 450, 99, 1, 0])]
    docs += [(None, [7, 8]), (None, [])]
    stream = one_file(kind, docs)
    reader = token_files.Reader(stream, len(stream.getvalue()))
    flat = [i for _, ids in docs for i in ids]
    found = [(d, at, np.frombuffer(ids, "<u4").tolist()) for d, at, ids in reader.documents()]
    assert [(d, ids) for d, _, ids in found] == docs
    assert [at for _, at, _ in found] == [sum(len(i) for _, i in docs[:k]) for k in range(len(docs))]
    for start, stop in [(0, 0), (0, 1), (99, 101), (150, 420), (len(flat) - 1, len(flat)), (0, len(flat))]:
        assert reader.range(start, stop).tolist() == flat[start:stop]
    assert len(reader.chunks) == -(-len(flat) // 100)


def test_planes_compress_and_damage_is_seen():
    ids = np.random.default_rng(4).zipf(1.3, 50_000) % 49_408
    stream = one_file("byte", [(1, ids.tolist())], 1 << 14)
    data = stream.getvalue()
    assert len(data) < 2.2 * len(ids)  # of 4 bytes an id
    for broken in (data[:-1], data[: len(data) // 2], data[:-40] + b"\x00" * 4 + data[-36:]):
        with pytest.raises((ValueError, struct.error)):
            token_files.Reader(io.BytesIO(broken), len(broken))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_documents(spark, kind):
    folder = common.new_path(spark, "planes")
    docs = cases.documents(spark, extra={"start": "1", "ids": "2", "part": "3"})
    manifest = token_files.write(docs, folder, WORDS, end=1, kind=kind)
    found = token_files.read(manifest, folder).orderBy("start", "doc_id").collect()
    tokenizer = Tokenizer.from_file(WORDS)
    assert len(found) == len(cases.DOCS)
    texts = sorted(((d, t or "") for d, t, *_ in cases.DOCS), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, (doc, text) in zip(found, texts, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert row["ids"] == struct.pack(f"<{len(ids)}I", *ids)
        at += len(ids)


def test_no_documents(spark):
    folder = common.new_path(spark, "planes")
    manifest = token_files.write(cases.documents(spark, []), folder, WORDS)
    assert manifest.count() == 0 and token_files.read(manifest, folder).collect() == []


def test_pieces_of_white_space_text_encode_alone():
    """What is held per piece of text is what the library gives for whole texts."""
    codec, tokenizer = token_files.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    texts = [
        "Don't  stop\n\nme 12,345 …\t\u00a0now\u2003x", "e\u0301 \u0301a < \u0338b", "<|endoftext|> a<|startoftext|>b",
        "ΑΣ ΣΑΣ İI", "\r\n \x85 \u200b a", "", " ", "日本 語\u3000テ",
    ]
    for text, packed in zip(texts, codec.encode(texts, None), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_pieces_go_to_the_tokenizer_together():
    """Few texts for many new pieces, with the ids that the library gives for each whole text."""
    codec, tokenizer, asked = token_files.WordCodec(WORDS), Tokenizer.from_file(WORDS), []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    codec.tokenizer = Counted()
    texts = [" ".join(f"w{i * j}x'{j}" for j in range(200)) for i in range(1, 6)]
    mark = token_files.MARK
    texts += [f"a{mark}b {mark} c", mark, f"{mark}{mark} \u0301x", "", "<|endoftext|> \u0301 'S ΑΣ", "\u2003 \u0338"]
    pieces = {p for t in texts for p in t.split(" ")}
    for one_by_one in (False, True):
        if one_by_one:
            codec.mark, codec.now, codec.before = None, {}, {}
        asked.clear()
        for text, packed in zip(texts, codec.encode(texts, None), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(asked) == len(pieces) if one_by_one else len(asked) < len(pieces) / 8


def test_held_pieces_pass_to_the_next_generation(monkeypatch):
    monkeypatch.setattr(token_files, "HELD", 3)
    codec, tokenizer = token_files.WordCodec(WORDS), Tokenizer.from_file(WORDS)
    for text in ["a b c d", "d e", "a f g h i", "a d", "b"]:
        (packed,) = codec.encode([text], 1)
        assert np.frombuffer(packed, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_query_on_all_documents(spark):
    from voicelane.llm import catalog

    folder = "/root/testdata/sf0.001"
    tokenizer, at = Tokenizer.from_file(WORDS), 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["op9_token_files"](spark, folder).collect()}
    for row in docs:
        ids = [*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1]
        assert found[row["doc_id"]] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)

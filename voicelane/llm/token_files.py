"""Token ids in files of compressed planes.

Ids of documents in ascending order of document id are cut into blocks of fixed size. A block is
transposed, so that the first bits (or bytes) of all its ids come together, then the second, and so
on; high planes are nearly constant, and every plane is compressed by itself with Zstandard. A file
ends with an index of its chunks (blocks) and documents, so any range of ids can be read alone:

    magic | planes of chunk 0, 1, ... | chunk index | document index | footer

    chunk index     per chunk: offset, then the length of each plane (unsigned 64-bit)
    document index  document ids, then numbers of ids (signed 64-bit), compressed together
    footer          offsets of both indexes, number of chunks, planes, ids, documents, ids per block,
                    checksum of all these (unsigned 64-bit), magic

One file per range of document ids. Files are written to the shared folder under names of their own;
those that count are in a manifest that Spark commits, so what a lost or repeated task leaves behind
is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voicelane.llm import common
from voicelane.llm.common import held, parts

MAGIC, FOOTER = b"VLPLANE1", "<8Q8s"  # struct format
BLOCK_IDS, LEVEL = 1 << 16, 3
#: Pieces of text whose ids are held per worker process: a bound on memory, not on what is encoded.
HELD = 500_000
#: What stands between pieces that are encoded as one text, and how many are.
MARK, MARKED = "\x01", 32
#: Bytes of ids in a batch that a reader hands on.
BATCH_BYTES = 4 << 20


# -- ids of texts ---------------------------------------------------------------------------------


class WordCodec:
    """A tokenizer that never joins what white space separates: texts are encoded piece by piece,
    and ids of recent pieces are held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # A mark between pieces that gives one id by itself lets many be encoded as one text.
        mark = self._ids([MARK, f"a {MARK} b", "a", "b"])
        self.mark = int(mark[0][0]) if len(mark[0]) == 1 and mark[1].tolist() == [*mark[2], *mark[0], *mark[3]] else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _made(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces with their ids, each as it is encoded by itself. Pieces that hold the mark go alone."""
        plain = [p for p in pieces if MARK not in p] if self.mark is not None else []
        alone = [p for p in pieces if MARK in p] if self.mark is not None else pieces
        groups = [plain[k : k + MARKED] for k in range(0, len(plain), MARKED)]
        for group, ids in zip(groups, self._ids([f" {MARK} ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(group) - 1:
                alone = alone + group
                continue
            packed, start = ids.tobytes(), 0
            for piece, end in zip(group, [*ends, len(ids)], strict=True):
                yield piece, packed[4 * start : 4 * end]
                start = end + 1
        for piece, ids in zip(alone, self._ids(alone), strict=True):
            yield piece, ids.tobytes()

    def encode(self, texts: list[str], end: int | None) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.now) > HELD:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        new = set().union(*cut).difference(now)
        if before:
            now.update((p, b) for p in new if (b := before.get(p)) is not None)
            new = new.difference(now)
        now.update(self._made(list(new)))
        tail = b"" if end is None else struct.pack("<I", end)
        return [b"".join(map(now.__getitem__, pieces)) + tail for pieces in cut]


def word_codec(path: str) -> WordCodec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    return held(("words", path), lambda: WordCodec(path))


# -- planes ---------------------------------------------------------------------------------------


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 of bytes or 32 of bits, low ones first."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def joined(parts: list[bytes], count: int) -> np.ndarray:
    """The ids of a block from its planes."""
    rows = np.stack([np.frombuffer(p, dtype=np.uint8) for p in parts])
    if len(parts) == 32:
        bits = np.unpackbits(rows, axis=1, count=count)
        rows = np.packbits(bits, axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Writer:
    """Writes one file to a stream, document by document."""

    def __init__(self, stream, kind: str = "byte", block: int = BLOCK_IDS):
        import zstandard

        self.stream, self.kind, self.block = stream, kind, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.pending, self.held = [], 0
        self.chunks, self.docs, self.sizes = [], [], []
        self.at, self.ids = len(MAGIC), 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.pending.append(ids)
        self.held += len(ids) // 4
        self.ids += len(ids) // 4
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), dtype="<u4")
        until = len(ids) if last else len(ids) - len(ids) % self.block
        for start in range(0, until, self.block):
            packed = [self.pack(p) for p in planes(ids[start : min(start + self.block, until)], self.kind)]
            self.chunks.append([self.at, *map(len, packed)])
            for p in packed:
                self.stream.write(p)
                self.at += len(p)
        self.pending, self.held = [ids[until:].tobytes()], len(ids) - until

    def close(self) -> None:
        self._flush(True)
        count = 32 if self.kind == "bit" else 4
        index = np.array(self.chunks, dtype="<u8").tobytes()
        null = np.iinfo(np.int64).min  # stands for a null id
        docs = np.array([null if d is None else d for d in self.docs], dtype="<i8")
        table = self.pack(docs.tobytes() + np.array(self.sizes, dtype="<i8").tobytes())
        counts = (self.at, self.at + len(index), len(self.chunks), count, self.ids, len(docs), self.block)
        check = zlib.crc32(index + table + struct.pack("<7Q", *counts))
        self.stream.write(index + table + struct.pack(FOOTER, *counts, check, MAGIC))


class Reader:
    """Reads one file (any object with ``seek`` and ``read``)."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        footer = struct.unpack(FOOTER, self._bytes(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        *counts, check, magic = footer
        index_at, docs_at, chunks, planes_, self.ids, docs, self.block = counts
        if magic != MAGIC:
            raise ValueError("not a whole file of token planes")
        index = self._bytes(index_at, docs_at - index_at)
        table = self._bytes(docs_at, size - struct.calcsize(FOOTER) - docs_at)
        if zlib.crc32(index + table + struct.pack("<7Q", *counts)) != check:
            raise ValueError("a damaged file of token planes")
        self.chunks = np.frombuffer(index, dtype="<u8").reshape(chunks, planes_ + 1)
        both = np.frombuffer(self.unpack(table), dtype="<i8")
        self.docs, self.sizes = both[:docs], both[docs:]

    def _bytes(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def chunk(self, number: int) -> np.ndarray:
        at, *lengths = self.chunks[number].tolist()
        raw = self._bytes(at, sum(lengths))
        cuts = np.cumsum([0, *lengths]).tolist()
        parts = [self.unpack(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return joined(parts, min(self.block, self.ids - number * self.block))

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``, reading only the chunks that hold them."""
        if start >= stop:
            return np.empty(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        ids = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return ids[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Each document's id, the ids before it in the file, and its ids; one chunk at a time."""
        null, at, left, number = np.iinfo(np.int64).min, 0, np.empty(0, dtype="<u4"), 0
        for doc, size in zip(self.docs.tolist(), self.sizes.tolist(), strict=True):
            parts, have = [left], len(left)
            while have < size:
                parts.append(self.chunk(number))
                have, number = have + len(parts[-1]), number + 1
            whole = np.concatenate(parts) if len(parts) > 1 else left
            left = whole[size:]
            yield None if doc == null else doc, at, whole[:size].tobytes()
            at += size


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# -- operators ------------------------------------------------------------------------------------


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end: int | None = 1,
    kind: str = "byte",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encodes whole texts (null: empty) and writes them to ``folder`` in ascending order of id (null
    first); returns the manifest: ``part``, ``file``, ``docs``, ``ids``, ``start`` (ids in all files
    before).

    ``folder`` is a shared one, by path or URI, that all executors can write to. Rows with the same id
    are written one after the other. No documents give no files.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    target, base = _store(folder)
    target.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, codec, writer, stream = TaskContext.get().partitionId(), word_codec(tokenizer), None, None
        store, where = _store(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            for piece in parts(batch, [1]):
                if writer is None and piece.num_rows:
                    stream = store.open_output_stream(f"{where}/{name}")
                    writer = Writer(stream, kind)
                packed = codec.encode([t or "" for t in piece.column(1).to_pylist()], end)
                for doc, ids in zip(piece.column(0).to_pylist(), packed, strict=True):
                    writer.add(doc, ids)
        if writer is not None:
            writer.close()
            stream.close()
            row = {"part": [part], "file": [name], "docs": [len(writer.docs)], "ids": [writer.ids]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])
    manifest = common.written(ordered.mapInArrow(run, "part bigint, file string, docs bigint, ids bigint"), "manifest")
    # One row per file goes through one window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return common.written(manifest.repartition(max(1, spark.sparkContext.defaultParallelism)), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files in a manifest: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids`` (packed, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _store(folder)
        for batch in batches:
            for file, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path = f"{where}/{file}"
                with store.open_input_file(path) as opened:
                    rows, size = [], 0
                    for doc, at, ids in Reader(opened, opened.size()).documents():
                        rows.append((doc, start + at, len(ids) // 4, ids))
                        size += len(ids)
                        if size >= BATCH_BYTES:
                            yield made(rows)
                            rows, size = [], 0
                    if rows:
                        yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    return manifest.select("file", "start").mapInArrow(run, schema)

"""SentencePiece encoding and decoding.

A merge-type (BPE) model joins, again and again, the neighbours whose union has the best score. Its
result is the one sequence of pieces in which every two neighbours stay apart when they are merged
alone, so it can be found from left to right: take the longest piece that starts here (all matches
of a word come from one pass of an Aho-Corasick automaton), keep it if re-merging it with the piece
before leaves both as they are, otherwise try the next shorter piece; where none fits, step back and
mark the position as failed in a bit field, so that no position is tried from twice. Time is linear
in the text, however long a word.

Pieces never join certain neighbours (a word and the space after it; in most models also letters and
punctuation), so a text falls into short words that are encoded one by one. Ids of recent words are
held per worker process; what leaves the bounded store is simply encoded again.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane.llm import common
from voicelane.llm.common import held

SPACE = "▁"
#: Words and pairs of pieces held per worker process: a bound on memory, not on what is encoded.
HELD, LONGEST_HELD = 250_000, 64


class Held(dict):
    """Values made on demand. At ``HELD`` entries a new generation begins; what the one before has is
    taken over when it is asked for, the rest is dropped with it."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= HELD:
            self.before = dict(self)
            self.clear()
        if len(key) <= LONGEST_HELD:
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one merge-type SentencePiece model."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:  # a single character always matches
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.word = re.compile(self._words())
        # The usual settings, tried out: no normalisation but a space before the text.
        probe = " a  ﬁ\n\tÅ é ０ "
        self.plain = model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.fits = Held(self._fits)
        self.shorter = Held(self._shorter)
        self.ids_of = Held(self._ids_of)
        self.encoded = Held(self._encoded)

    def _words(self) -> str:
        """A pattern for words that can be encoded apart: no piece joins one to the next.

        A word is spaces and then either punctuation or anything else. What counts as punctuation is
        what pieces join to it; if that takes in letters, words end at spaces only.
        """
        joined = [(a, b) for p in self.score for a, b in zip(p, p[1:], strict=False)]
        if any(b == SPACE != a for a, b in joined):
            return "(?s).+"
        near = {}
        for a, b in joined:
            if a != SPACE:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        marks = {c for c in map(chr, range(128)) if c != " " and not c.isalnum()}
        todo = list(marks)
        while todo:
            new = near.get(todo.pop(), set()) - marks
            marks |= new
            todo += new
        if any(c.isalpha() for c in marks):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        kind = re.escape("".join(sorted(marks)))
        return f"{SPACE}*[^{SPACE}{kind}]+|{SPACE}*[{kind}]+|{SPACE}+"

    # -- one word ---------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                value = score.get(parts[i] + parts[i + 1])
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbours stay as they are when they are merged alone."""
        before, piece = pair
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def _shorter(self, piece: str) -> int:
        """Length of the next shorter piece that starts alike; a single character always counts."""
        size = len(piece) - 1
        while size > 1 and piece[:size] not in self.score:
            size -= 1
        return max(size, 0)

    def pieces(self, word: str) -> list[str]:
        """The pieces of a text, by backtracking over its longest matches."""
        n = len(word)
        longest = [1] * n
        for end, size in self.automaton.iter(word):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        failed = bytearray(n // 8 + 1)
        taken, at, before, fits, shorter = [], 0, "", self.fits, self.shorter
        size = longest[0] if n else 0
        while at < n:
            while size:
                end = at + size
                piece = word[at:end]
                if not failed[end >> 3] >> (end & 7) & 1 and fits[before, piece]:
                    break
                size = shorter[piece]
            if size:
                taken.append(piece)
                before, at = piece, end
                if at < n:
                    size = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= len(last)
                before = taken[-1] if taken else ""
                size = shorter[last]
        return taken

    def _ids_of(self, piece: str) -> bytes:
        """Packed ids of a piece: its own, or for an unknown character its bytes or the unknown id."""
        if piece in self.id_of:
            ids = [self.id_of[piece]]
        elif self.bytes:
            ids = [self.bytes[f"<0x{b:02X}>"] for b in piece.encode()]
        else:
            ids = [self.unknown]
        return np.array(ids, dtype="<u4").tobytes()

    def _encoded(self, word: str) -> bytes:
        return b"".join(map(self.ids_of.__getitem__, self.pieces(word)))

    # -- texts ------------------------------------------------------------------------------------

    def encode(self, text: str, begin: bool = False, end: bool = False) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        head = np.array([self.model.bos_id()] * begin, dtype="<u4").tobytes()
        tail = np.array([self.model.eos_id()] * end, dtype="<u4").tobytes()
        if not self.plain:
            text = self.model.normalize(text)
        elif text:
            text = SPACE + text.replace(" ", SPACE)
        ids = b"".join(map(self.encoded.__getitem__, self.word.findall(text)))
        return head + (ids if self.bytes else self._once(ids)) + tail

    def _once(self, packed: bytes) -> bytes:
        """A model without byte pieces gives one unknown id to a whole run of unknown characters."""
        ids = np.frombuffer(packed, dtype="<u4")
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.append([True], ~again)[: len(ids)]].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, dtype="<u4").tolist())


def codec(path: str) -> Codec:
    return held(("pieces", path), lambda: Codec(path))


def encode(
    docs: DataFrame,
    model: str,
    text: str = "text",
    begin: bool = True,
    end: bool = True,
    decoded: bool = True,
) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit ids of the whole text),
    ``n_tokens`` and, if wanted, ``decoded`` (the text that the ids decode to).

    Row by row: no shuffle. Null counts as the empty text, which has no ids but begin and end.
    Columns named like an output are replaced; all others stay. ``model`` is a path that executors
    can read.
    """

    def rows(texts):
        own = codec(model)
        ids = [own.encode(t or "", begin, end) for t in texts]
        made = [ids, [len(i) // 4 for i in ids]]
        return [*made, [own.decode(i) for i in ids]] if decoded else made

    outputs = "ids binary, n_tokens bigint" + ", decoded string" * decoded
    return common.extended(docs, {text: F.col(f"`{text}`")}, outputs, rows)


def decode(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of packed ids; null ids give the empty text."""

    def rows(packed):
        own = codec(model)
        return [[own.decode(i or b"") for i in packed]]

    return common.extended(docs, {ids: F.col(f"`{ids}`")}, "decoded string", rows)

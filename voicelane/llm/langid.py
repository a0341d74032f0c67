"""Language of texts, also of their parts.

Words are runs of letters. The script of a word (by code point ranges) leaves the languages that are
written in it; each of them gives the word the sum of log probabilities of its letter trigrams. The
best labelling of all words of a text, with a penalty for every change of language between two words,
is found by Viterbi's algorithm; runs of one label are the spans. Where no other language leads by
the penalty over any stretch of words, nor others over a beginning and an end together, changing
cannot pay, and the single best language is the answer without going through the words.

A model is counted from labelled texts: trigrams per language, hashed into a fixed number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane.llm import common
from voicelane.llm.common import held, parts

CELLS = 1 << 16
#: Log probability that a change of language costs; and that a word not in its script costs.
SWITCH, FOREIGN = 15.0, 30.0
#: Sums that are this near to the penalty are left to Viterbi's algorithm.
ROUNDING = 1e-6
#: A script belongs to a language if it has this share of its letters.
OF_SCRIPT = 0.01
#: Scores (words of a batch times languages) that are in memory at once.
AT_ONCE = 1_000_000

# First code points of script ranges, and the script from there on (0: other).
SCRIPT_RANGES = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"), (0x1800, ""),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Hiragana"), (0x30A0, "Katakana"),
    (0x3100, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB10, ""), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFEFF, ""), (0xFF21, "Latin"),
    (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x32000, ""),
)
SCRIPTS = ("", *dict.fromkeys(name for _, name in SCRIPT_RANGES if name))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # cells x languages, log probabilities
    written_in: np.ndarray  # scripts x languages, whether


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case letter (0 if it is none), and its script."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            lower[point] = ord(low) if len(low) == 1 else point
    script = np.zeros(0x110000, dtype=np.uint8)
    for first, name in SCRIPT_RANGES:
        script[first:] = SCRIPTS.index(name)
    return lower, script


def _features(texts: list[str]) -> dict:
    """Letters of texts with their trigram cells, and where words and texts begin."""
    lower, scripts = held(("letters",), _letters)
    joined = "\n".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    letters = lower[points]
    at = np.flatnonzero(letters)
    mixed = letters * np.uint32(2654435761) + np.roll(letters, 1) * np.uint32(2246822519)
    mixed += np.roll(letters, -1) * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(668265263)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(lengths + 1) - lengths
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else at
    return {
        "at": at,
        "cells": (mixed[at] >> np.uint32(16)).astype(np.int64),
        "script": scripts[points[at]],
        "first": first,
        "text": np.searchsorted(begins, at[first], side="right") - 1,
        "begins": begins,
    }


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all texts with a language; the driver gets counters per language and cell, not rows.

    Rows without text or language teach nothing; without any row the model knows no language.
    """
    labelled = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    width = CELLS + len(SCRIPTS)

    def count(batches):
        counts = {}
        for batch in batches:
            for part in parts(batch, [0]):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for own in set(langs):
                    found = _features([t for t, x in zip(texts, langs, strict=True) if x == own])
                    sums = counts.setdefault(own, np.zeros(width, dtype=np.int64))
                    sums[:CELLS] += np.bincount(found["cells"], minlength=CELLS)
                    sums[CELLS:] += np.bincount(found["script"], minlength=len(SCRIPTS))
        for own, sums in counts.items():
            some = np.flatnonzero(sums)
            columns = [pa.array([own] * len(some), pa.string()), pa.array(some), pa.array(sums[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "cell", "n"])

    counted = labelled.mapInArrow(count, "lang string, cell bigint, n bigint")
    table = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].to_numpy(zero_copy_only=False)
    languages = sorted(set(names.tolist()))
    sums = np.zeros((width, len(languages)))
    column = np.searchsorted(np.array(languages, dtype=object), names) if languages else []
    sums[table["cell"].to_numpy(), column] = table["n"].to_numpy()
    grams, scripts = sums[:CELLS], sums[CELLS:]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * CELLS))
    return Model(languages, weights.astype(np.float32), scripts >= OF_SCRIPT * np.maximum(scripts.sum(axis=0), 1))


def _word_scores(found: dict, weights: np.ndarray, written_in: np.ndarray) -> np.ndarray:
    """Words x languages: log probability of each word."""
    scores = np.add.reduceat(weights[found["cells"]], found["first"], axis=0).astype(np.float64)
    possible = written_in[found["script"][found["first"]]]
    if not possible.all():
        none = ~possible.any(axis=1)
        best = np.where(possible, scores, -np.inf).max(axis=1, initial=-np.inf)
        scores = np.where(possible, scores, np.minimum(scores, (best - FOREIGN)[:, None]))
        scores[none] = 0.0
    return scores


def _single(scores: np.ndarray) -> int | None:
    """The only language of a text, if no change between languages can pay.

    With c changes, other languages have at most a beginning, an end and c - 1 stretches between them.
    """
    best = int(scores.sum(axis=0).argmax())
    lead = np.cumsum(scores - scores[:, [best]], axis=0)
    until = np.vstack([np.zeros((1, lead.shape[1])), lead[:-1]])
    stretch = (lead - np.minimum.accumulate(until, axis=0)).max()
    ends = max(lead.max(), 0.0) + max((lead[-1] - until).max(), 0.0)
    return best if max(stretch, ends) < SWITCH - ROUNDING else None


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word (rows: words, columns: labels) with a penalty for each change."""
    n, labels = scores.shape
    back = np.zeros((n, labels), dtype=np.int32)
    own, value = np.arange(labels), scores[0].copy()
    for i in range(1, n):
        top = int(value.argmax())
        moved = value[top] - switch
        stays = value >= moved
        back[i] = np.where(stays, own, top)
        value = np.where(stays, value, moved) + scores[i]
    path = np.empty(n, dtype=np.int32)
    path[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _labelled(texts: list[str], model: Model) -> list[tuple[str, float, list[dict]]]:
    out = [("und", 0.0, [])] * len(texts)
    found = _features(texts)
    if not len(found["at"]) or not model.languages:
        return out
    scores = _word_scores(found, model.weights, model.written_in)
    first, at = found["first"], found["at"]
    sizes = np.diff(np.append(first, len(at)))
    edges = np.flatnonzero(np.append(True, found["text"][1:] != found["text"][:-1]))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(first)], strict=True):
        number = int(found["text"][lo])
        own = scores[lo:hi]
        label = _single(own)
        path = np.full(hi - lo, label) if label is not None else viterbi(own)
        letters = np.bincount(path, weights=sizes[lo:hi], minlength=len(model.languages))
        best = int(letters.argmax())
        cuts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        lasts = np.append(cuts[1:], hi - lo) - 1
        base = found["begins"][number]
        spans = [
            {
                "begin": int(at[first[lo + a]] - base),
                "end": int(at[first[lo + b] + sizes[lo + b] - 1] + 1 - base),
                "lang": model.languages[path[a]],
            }
            for a, b in zip(cuts.tolist(), lasts.tolist(), strict=True)
        ]
        out[number] = (model.languages[best], float(letters[best] / letters.sum()), spans)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of the letters that its spans have) and ``spans``
    (``begin``, ``end`` in code points, ``lang``).

    Row by row. Null texts, texts without a letter and a model without languages give ``und``, score
    0 and no spans. Words in a script of no language count for none.
    """
    # plain lists and arrays only: a broadcast pickles by name, and executors need not have this package
    shared = docs.sparkSession.sparkContext.broadcast((list(model.languages), model.weights, model.written_in))
    step = max(1, AT_ONCE // max(1, len(model.languages)))

    def rows(texts):
        own, made, group, size = Model(*shared.value), [], [], 0
        for t in [*(t or "" for t in texts), None]:
            if t is None or (group and size + len(t) > step):
                made += _labelled(group, own)
                group, size = [], 0
            if t is not None:
                group.append(t)
                size += len(t)
        return [list(c) for c in zip(*made, strict=True)] if made else [[], [], []]

    outputs = "lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>"
    return common.extended(docs, {text: F.col(f"`{text}`")}, outputs, rows)

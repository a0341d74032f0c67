"""Language identification from character-gram profiles.

Training is one Spark job over labelled text. A profile has all grams of one to three letters that a
language uses, so its size depends on alphabets, not on the corpus; it is measured before it travels
with the tasks. Detection is row by row: an Arrow function that looks grams up in sorted arrays, with
no shuffle and no per-row Python loop.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voicelane.functions.matching import bound

DEFAULT_LANGUAGE = "en"
# Largest weight table that travels with tasks. Profiles grow with alphabets, not with the corpus.
MAX_PROFILE_BYTES = 256 << 20
# Weights are whole thousandths of a natural logarithm: sums are exact in any order.
SCALE = 1000
# Characters handled at once inside a task: its arrays then stay in the CPU caches, and a batch of
# long texts needs little memory.
SLICE_CHARS = 200_000
# Largest table of gram numbers kept as a plain array (128 MiB); beyond it grams are searched for.
DENSE_IDS = 1 << 24


def letters_only(text: Column) -> Column:
    """Lower-case words between single blanks, with a blank at both ends."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _grams(word: Column) -> Column:
    """1-, 2- and 3-grams of a word with a blank on both sides, without the blank itself."""

    def runs(chars: Column) -> Column:
        twos = F.transform(
            F.sequence(F.lit(0), F.size(chars) - 2),
            lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1)),
        )
        threes = F.transform(
            F.sequence(F.lit(0), F.size(chars) - 3),
            lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)),
        )
        return F.concat(F.slice(chars, 2, F.size(chars) - 2), twos, threes)

    return bound(F.split(F.concat(F.lit(" "), word, F.lit(" ")), ""), runs)


def language_profile(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    grams: int | None = None,
) -> DataFrame:
    """The grams of each language with their weights: all, or the ``grams`` most frequent ones.

    Words are counted first, so grams are cut out of distinct words only and both shuffles carry
    counters.
    """
    words = (
        labelled.filter(F.col(lang).isNotNull())
        .select(
            F.col(lang).alias("lang"),
            F.explode(F.split(F.trim(letters_only(F.col(text))), " ")).alias("word"),
        )
        .filter(F.col("word") != "")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    counted = (
        words.select("lang", F.explode(_grams(F.col("word"))).alias("gram"), "n")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    kept = counted.withColumn("rank", F.row_number().over(by_rank))
    if grams is not None:
        kept = kept.filter(F.col("rank") <= grams)
    mass = F.sum("n").over(Window.partitionBy("lang")).cast("double")
    weight = F.bround(F.log(F.col("n") / mass) * SCALE, 0).cast("bigint")
    floor = F.bround(F.log(F.lit(0.5) / mass) * SCALE, 0).cast("bigint")
    return kept.select(
        "lang",
        "gram",
        "n",
        F.col("rank").cast("bigint").alias("rank"),
        weight.alias("weight"),
        floor.alias("floor_weight"),
    )


def _lookup(ids: np.ndarray, rows: np.ndarray, size: int, missing: int):
    """Gram ids to profile rows (``missing`` where unknown): by table if it fits, else by search."""
    if size <= DENSE_IDS:
        table = np.full(size, missing, dtype=np.intp)
        table[ids] = rows
        return lambda wanted: table[wanted]
    order = np.argsort(ids)
    ids, rows = ids[order], rows[order]

    def search(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
        return np.where(ids[at] == wanted, rows[at], missing)

    return search


class _Profile:
    """Arrays for scoring: letters are numbered, a gram is a number with letters as its digits."""

    def __init__(self, grams: list[str], weights: np.ndarray) -> None:
        letters = sorted({c for g in grams for c in g})
        self.base = len(letters) + 1  # digit 0 is any other character
        self.digit = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        self.digit[[ord(c) for c in letters]] = np.arange(1, self.base)
        # One column more counts known grams; one row more stands for unknown ones.
        counted = np.column_stack([weights, np.ones(len(grams), dtype=np.int64)])
        padded = np.vstack([counted, np.zeros(counted.shape[1], dtype=np.int64)])
        self.columns = [np.ascontiguousarray(column) for column in padded.T]
        self.lookups = []
        for size in (1, 2, 3):
            rows = np.array([r for r, g in enumerate(grams) if len(g) == size], dtype=np.intp)
            codes = np.array([[ord(c) for c in grams[r]] for r in rows]).reshape(-1, size)
            self.lookups.append(
                _lookup(self._ids(self.digit[codes].T), rows, self.base**size, len(grams))
                if len(rows)
                else None
            )

    def _ids(self, digits) -> np.ndarray:
        ids = digits[0]
        for following in digits[1:]:
            ids = ids * self.base + following
        return ids

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the sums per language, and how many grams were known. No text is empty."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        # Two unknown characters at the end let every position start a gram of each size.
        digits = np.concatenate([self.digit[codes], [0, 0]])
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        total = np.zeros((len(texts), len(self.columns)), dtype=np.int64)
        for size, find in enumerate(self.lookups, start=1):
            if find is not None:
                rows = find(self._ids([digits[i : i + len(codes)] for i in range(size)]))
                for column, values in enumerate(self.columns):
                    total[:, column] += np.add.reduceat(values[rows], starts)
        return total[:, :-1], total[:, -1]


def save_profile(profile: DataFrame, path: str) -> None:
    """Stores a profile, so that detection need not count the corpus again."""
    profile.write.mode("overwrite").parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def detector(profile: DataFrame, default: str = DEFAULT_LANGUAGE) -> Callable[[Column], Column]:
    """A column function for the language of a text; text without known letters is ``default``.

    Every gram of the text that some profile knows adds its weight to each language (a language
    that does not know it adds its floor); the largest sum wins, ties go to the first code.
    """
    size = profile.agg(F.countDistinct("lang") * F.countDistinct("gram") * 8).first()[0]
    if size > MAX_PROFILE_BYTES:
        raise ValueError(f"the profile needs {size} bytes, more than {MAX_PROFILE_BYTES}")
    rows = profile.select("lang", "gram", "weight", "floor_weight").collect()
    langs = sorted({r["lang"] for r in rows})
    names = sorted({r["gram"] for r in rows})
    place = {name: i for i, name in enumerate(names)}
    number = {lang: i for i, lang in enumerate(langs)}
    floors = {r["lang"]: r["floor_weight"] for r in rows}
    weights = np.tile(np.array([floors[lang] for lang in langs], dtype=np.int64), (len(names), 1))
    for r in rows:
        weights[place[r["gram"]], number[r["lang"]]] = r["weight"]

    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _Profile(names, weights) if names else None
        for batch in batches:
            values = batch.to_pylist()
            out: list[str] = []
            for part in _slices(values):
                if model is None:
                    out += [default] * len(part)
                    continue
                sums, known = model.scores(part)
                out += [
                    langs[b] if k else default
                    for b, k in zip(np.argmax(sums, axis=1), known, strict=True)
                ]
            yield pa.array(out, pa.string())

    ask = F.arrow_udf(detect, "string")
    return lambda text: ask(letters_only(text))


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive parts of about ``SLICE_CHARS`` characters, at least one text each."""
    part: list[str] = []
    chars = 0
    for text in texts:
        if part and chars + len(text) > SLICE_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part

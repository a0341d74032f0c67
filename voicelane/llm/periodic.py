"""Periodic runs of words: maximal repetitions found by string synchronising sets.

A *run* is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal),
at least ``max(least, 2 q)`` words long, that neither neighbouring word extends with period ``q``.

Method, per document (words become integer ids first, so equality is exact):

* **Periods up to** :data:`SMALL` are scanned directly.
* **Synchronising sets at dyadic scales.** Scale ``tau = 2, 4, 8, ...`` answers for the periods from
  ``3 tau`` to below ``6 tau``, so each larger period has one scale. Each position gets a hash of its
  ``tau`` words; position ``i`` is *synchronising* when the least hash of ``i .. i + tau`` sits at ``i``
  or ``i + tau``. The choice depends only on the ``2 tau`` words from ``i`` on (local consistency).
  From ``tau = 16`` on, positions whose ``tau`` words have a period of at most ``tau / 3`` take no part;
  the runs of the scales before tell exactly which these are.
* **Equal-context pairs propose periods.** Chosen positions are grouped by the hash of their
  ``2 tau``-word context. Of a group, the distances of *all* members that lie ``3 tau`` to ``6 tau``
  apart are proposed; no number of members is cut off.
* **Adjoining runs of one small period** propose the distances that bring their phases together.
* **Verification.** Every proposed period ``q`` is checked against all words: maximal stretches where
  word ``i`` equals word ``i + q`` are runs when long enough and when no divisor of ``q`` is a period of
  the stretch too. Hashes only propose; nothing is accepted without exact comparison.

No run is missed. Take a run ``[s, e)`` of smallest period ``q``, ``3 tau <= q < 6 tau``, and the positions
whose ``3 tau - 1`` words lie in ``[s, e - q)``, which has at least ``q`` words. If not all ``2 tau`` positions
from ``i`` on are left out, the least hash among them makes one of ``i .. i + tau - 1`` synchronising, by its
position or by that less ``tau``; its context recurs ``q`` words on, inside the run, so ``q`` is proposed. If
all are left out for every such ``i``, ``[s, e - q)`` has one period ``d <= tau / 3``, as windows that overlap
in ``tau - 1`` words share their period. It lies in a run ``A`` of period ``d`` and its repetition
``[s + q, e)`` in another one, ``B`` (in the same one ``q`` would not be the smallest period, by Fine and
Wilf). ``B`` begins after ``A``, at most at its end, so it is the next run of period ``d``; ``q`` is at
most as long as either, and words of ``A`` equal those ``q`` further on in ``B``: such ``q`` are one residue modulo
``d``, and all of these are proposed.

It stays near-linear: from ``tau = 16`` on equal contexts are over ``tau / 3`` apart (their smallest period
is larger), so a member has at most 18 partners within ``6 tau``; below, there are fewer than 48.

Defined results: a null text has no words; a text without words or with fewer than ``least`` words has
no runs and an empty collapsed text; runs come ordered by start, then period. A word is dropped from
the collapsed text when some run contains it after that run's first ``q`` words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane.llm.common import extended

#: Periods up to this are scanned directly (highly periodic regions).
SMALL = 8
#: Scales up to this leave no position out (a partner is then less than ``6 * DENSE`` words away).
DENSE = 8
#: Shortest run, in words.
LEAST = 12
WORDS = r"[^\x20\x09-\x0D]+"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(values: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit values (wrapping arithmetic)."""
    z = values + _MIX  # arrays wrap silently
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal stretches of True."""
    edges = np.diff(np.concatenate(([False], equal, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _left_out(size: int, tau: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Of the first ``size`` positions, those whose ``tau`` words have a period of at most ``tau / 3``."""
    edges = np.zeros(size + 1, dtype=np.int32)
    for s, length, q in runs:
        if 3 * q <= tau <= length:
            edges[s] += 1
            edges[s + length - tau + 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def _proposals(window: np.ndarray, tau: int, out: np.ndarray | None) -> set[int]:
    """Distances from ``3 tau`` to below ``6 tau`` of synchronising positions with equal contexts.
    ``window`` has the hash of the ``tau`` words from each position, ``out`` the positions left out."""
    m = len(window) - tau  # positions with a full 2 tau context
    ranks = window if out is None else np.where(out, np.uint64(0xFFFFFFFFFFFFFFFF), window)
    # least hash of positions i .. i + tau, by doubling over powers of two below tau
    least, span = ranks, 1
    while span < tau:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    lowest = np.minimum(least[:m], ranks[tau:])
    first, last = ranks[:m] == lowest, ranks[tau:] == lowest
    if out is not None:
        first, last = first & ~out[:m], last & ~out[tau:]
    where = np.flatnonzero(first | last)
    keys = _mixed(window[where] * np.uint64(31) + window[where + tau])
    order = np.argsort(keys, kind="stable")
    keys, where = keys[order], where[order]
    found: set[int] = set()
    at, k = np.arange(len(keys)), 1  # members that may have a k-th next one within reach
    while len(at := at[at + k < len(keys)]):
        gaps = where[at + k] - where[at]
        near = (keys[at + k] == keys[at]) & (gaps < 6 * tau)
        at, gaps = at[near], gaps[near]
        found.update(np.unique(gaps[gaps >= 3 * tau]).tolist())
        k += 1
    return found


def _adjoining(ids: np.ndarray, d: int, runs: list[tuple[int, int, int]]) -> set[int]:
    """Distances at which a run of period ``d`` recurs in the next one that adjoins it: ``runs`` are those
    of period ``d``, by start."""
    found: set[int] = set()
    for (a, length, _), (start, following, _) in zip(runs, runs[1:], strict=False):
        end, longest = a + length, min(length, following)
        if start > end or longest < 9 * d:
            continue
        root = ids[start : start + d]
        for x in (np.flatnonzero(ids[end - 2 * d : end - d] == root[0]) + end - 2 * d).tolist():
            if np.array_equal(ids[x : x + d], root):
                least = 9 * d + (start - x - 9 * d) % d
                found.update(range(least, longest + 1, d))
                break
    return found


def _stretch_at(ids: np.ndarray, k: int, q: int) -> tuple[int, int]:
    """The maximal ``[start, end)`` around ``k`` in which word ``j`` equals word ``j + q`` (it holds at
    ``k``), found by comparing slices of doubling length outwards."""
    last, end, step = len(ids) - q, k, 16
    while end < last:
        high = min(last, end + step)
        miss = np.flatnonzero(ids[end:high] != ids[end + q : high + q])
        if len(miss):
            end += int(miss[0])
            break
        end, step = high, step * 2
    start, step = k, 16
    while start > 0:
        low = max(0, start - step)
        miss = np.flatnonzero(ids[low:start] != ids[low + q : start + q])
        if len(miss):
            start = low + int(miss[-1]) + 1
            break
        start, step = low, step * 2
    return start, end


def _factors(q: int) -> list[int]:
    """The prime factors of ``q``, each once."""
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return found + [q] if q > 1 else found


def _verified(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """The runs of period ``q``, by start.

    A run of period ``q`` has at least ``need = max(least, 2 q) - q`` consecutive positions where word
    ``j`` equals word ``j + q``, so one of them is a multiple of ``need``: only those positions are compared
    (strided slices), and each equal one is extended outwards exactly. Same runs as comparing every
    position, at ``n / need`` per period."""
    n, need, out = len(ids), max(least, 2 * q) - q, []
    if n - q < need:
        return out
    hits = np.flatnonzero(ids[0 : n - q : need] == ids[q:n:need]) * need
    covered, factors = -1, None
    for k in hits.tolist():
        if k < covered:
            continue
        s, end = _stretch_at(ids, k, q)
        covered, length = end, end - s + q
        if length < max(least, 2 * q):
            continue
        if factors is None:
            factors = _factors(q)
        part = ids[s : s + length]
        if any(np.array_equal(part[: -(q // p)], part[q // p :]) for p in factors):
            continue  # a divisor of q is a period: the run belongs to that one
        out.append((s, length, q))
    return out


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a sequence of integer ids, by start, then period.

    Periods are verified scale by scale, as a scale needs the runs of the smaller periods (also those
    that ``least`` leaves out of the result, from 12 words on)."""
    n = len(ids)
    if n < max(least, 2):
        return []
    floor, runs, adjoining = min(least, LEAST), [], set()

    def verify(periods) -> None:
        for q in sorted(periods):
            found = _verified(ids, q, floor)
            runs.extend(found)
            if len(found) > 1:
                adjoining.update(_adjoining(ids, q, found))

    verify(range(1, min(SMALL, n // 2) + 1))
    window, tau = _mixed(ids.astype(np.uint64)), 1  # hash of the tau words from each position
    while 3 * tau <= n // 2:
        if 6 * tau > SMALL + 1:
            out = _left_out(len(window), tau, runs) if tau > DENSE and runs else None
            asked = _proposals(window, tau, out) | adjoining
            verify(q for q in asked if max(3 * tau, SMALL + 1) <= q < 6 * tau and q <= n // 2)
        window = _mixed(window[:-tau] * np.uint64(0x100000001B3) ^ window[tau:])
        tau *= 2
    return sorted((r for r in runs if r[1] >= least), key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    dropped = np.zeros(len(words) + 1, dtype=np.int32)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    gone = np.cumsum(dropped[:-1]) > 0
    return [w for w, g in zip(words, gone) if not g]


def _words(text: str | None) -> list[str]:
    import regex

    return regex.findall(WORDS, text) if text else []


def _batch(texts: list) -> tuple[list, list]:
    runs, collapsed = [], []
    for text in texts:
        words = _words(text)
        if words:
            number: dict[str, int] = {}
            found = runs_of(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
        else:
            found = []
        runs.append([{"start": s, "length": l, "period": q} for s, l, q in found])
        collapsed.append(" ".join(collapsed_words(words, found)))
    return runs, collapsed


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of ``start, length, period``, word numbers from 0) and
    ``collapsed`` (the kept words joined by one space). Row-local: no shuffle; texts travel to Python in
    Arrow slices of bounded bytes. Other columns pass through; ones named ``runs`` or ``collapsed`` are
    replaced."""
    return extended(
        docs,
        {"text": F.col(f"`{text}`")},
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string",
        _batch,
    )


def arrow_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

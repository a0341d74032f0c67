"""Near-duplicates by SimHash fingerprints within a Hamming distance.

Fingerprints are found by the generalised pigeonhole principle. The 64 bits are cut into parts; if
the thresholds of the parts add up to the distance less the number of parts plus one, two
fingerprints within the distance are within the threshold in at least one part. Bits that are
correlated go to the same part, so that the parts tell independent things. Thresholds need not be
equal: dynamic programming gives each part the one (-1: not looked at) that costs least in total, by
the number of signatures to send and the number of candidates expected from the distances that the
fingerprints have in each part; the number of parts is chosen in the same way. So a larger table gets
fewer, wider parts with larger thresholds, and candidates do not grow with its square.

Each fingerprint is filed under its bits in every part and asks for all values within the threshold.
Candidates are verified inside the join, which the adaptive planner splits where a value is frequent;
only true links leave it, each once.

``similar_kept`` links by Jaccard similarity instead and finds all pairs: see "similar sets".
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelane.llm import common

SEED = 42
BITS, BLOCK = 64, 8
#: Documents that show which shingles are frequent, and how many of these are told apart. Both only
#: change the work of :func:`similar_kept`, not its result.
SAMPLE, FREQUENT = 2_048, 1 << 16
#: Costs for the choice of parts: a signature that is sent and sorted, a candidate that is compared.
ROW_COST, CANDIDATE_COST = 1.0, 0.004


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; of all words where there are fewer."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    count = max(1, len(words) - width + 1)
    parts = map(slice, starts[:count].tolist(), ends[-count:].tolist())
    digests = map(xxhash.xxh64_digest, map(joined.__getitem__, parts), itertools.repeat(SEED))
    return np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes (``sizes`` of them, none gives 0) the bits set in over half of it.

    Bits are added up eight at a time, one per byte, over at most 255 hashes, then per run.
    """
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    lengths = sizes[some]
    starts = np.cumsum(lengths) - lengths
    chunks = -(-lengths // 255)
    first = np.cumsum(chunks) - chunks
    within = np.arange(chunks.sum()) - np.repeat(first, chunks)
    at = np.repeat(starts, chunks) + within * 255
    counts = np.empty((len(some), BITS), dtype=np.int64)
    ones = np.uint64(0x0101010101010101)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & ones, at)
        each = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, shift::8] = np.add.reduceat(each, first, axis=0)
    bits = counts * 2 > lengths[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprinted(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with ``fp`` (the fingerprint as a long) and ``shingles`` (their number).

    Over all shingles with their repeats. Null texts have no words; fingerprints without words are 0.
    """

    def rows(texts):
        found = [shingle_hashes(t or "", width) for t in texts]
        sizes = np.array([len(h) for h in found], dtype=np.int64)
        flat = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        return [majority(flat, sizes).view(np.int64), sizes]

    return common.extended(docs, {text: F.col(f"`{text}`")}, "fp bigint, shingles bigint", rows)


# -- parts and thresholds -------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    mask: int  # as a signed long
    width: int
    threshold: int

    def flips(self) -> list[int]:
        """Masks that turn a value into all values within the threshold."""
        bits = [1 << b for b in range(BITS) if self.mask >> b & 1]
        flips = [sum(c) for t in range(self.threshold + 1) for c in itertools.combinations(bits, t)]
        return [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]


def _matrix(fps: DataFrame, of, name: str) -> np.ndarray:
    """A table of counters over all fingerprints, counted per task and added up."""

    def run(batches):
        total = None
        for batch in batches:
            counts = of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total = counts if total is None else total + counts
        if total is not None:
            flat = total.ravel()
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["at", "n"])

    sums = fps.select("fp").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    shape = {"pairs": (BITS, BITS), "values": (BITS // BLOCK, 1 << BLOCK)}[name]
    out = np.zeros(math.prod(shape), dtype=np.int64)
    for row in sums.collect():  # at most 4,096 counters
        out[row["at"]] = row["n"]
    return out.reshape(shape)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def together(pairs: np.ndarray, count: int) -> list[list[int]]:
    """Bits in blocks of eight, the most correlated together. ``pairs``: how often two bits are set
    in one fingerprint."""
    mean = np.diag(pairs) / max(count, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.abs(pairs / max(count, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, blocks = set(range(BITS)), []
    while left:
        rest = sorted(left)
        block = [rest[int(np.argmax(related[np.ix_(rest, rest)].max(axis=1)))]]
        while len(block) < BLOCK:
            rest = sorted(left - set(block))
            block.append(rest[int(np.argmax(related[np.ix_(rest, block)].sum(axis=1)))])
        blocks.append(sorted(block))
        left -= set(block)
    return blocks


def distances(values: np.ndarray) -> np.ndarray:
    """Share of pairs of fingerprints at each distance in a block, from how often it has each value."""
    share = values / max(values.sum(), 1)
    apart = np.bitwise_count(np.arange(1 << BLOCK)[:, None] ^ np.arange(1 << BLOCK))
    return np.bincount(apart.ravel(), weights=np.outer(share, share).ravel(), minlength=BLOCK + 1)


def allocated(widths: list[int], shares: list[np.ndarray], distance: int, count: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that add up to the distance less the parts plus one, and the cost."""
    best = {0: (0.0, [])}
    for width, share in zip(widths, shares, strict=True):
        reached = np.cumsum(share)
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, taken) in best.items():
            for t in range(-1, min(distance, width) + 1):
                more = 0.0
                if t >= 0:
                    ball = sum(math.comb(width, k) for k in range(t + 1))
                    more = ROW_COST * count * (1 + ball) + CANDIDATE_COST * count * count * reached[t]
                if total + t not in now or cost + more < now[total + t][0]:
                    now[total + t] = (cost + more, [*taken, t])
        best = now
    return best.get(distance - len(widths) + 1, (math.inf, []))


def planned(fps: DataFrame, distance: int) -> list[Part]:
    """The parts to look at, chosen from statistics of all fingerprints."""
    count = fps.count()
    blocks = together(_matrix(fps, lambda v: _cooccurring(v), "pairs"), count)
    values = _matrix(fps, lambda v: _block_values(v, blocks), "values")
    shares = [distances(v) for v in values]
    found = (math.inf, [])
    for parts in range(1, len(blocks) + 1):
        cuts = [round(len(blocks) * k / parts) for k in range(parts + 1)]
        spans = [range(a, b) for a, b in itertools.pairwise(cuts)]
        widths = [BLOCK * len(s) for s in spans]
        joint = []
        for span in spans:
            share = np.ones(1)
            for b in span:
                share = np.convolve(share, shares[b])
            joint.append(share)
        cost, taken = allocated(widths, joint, distance, count)
        if cost < found[0]:
            made = []
            for span, width, t in zip(spans, widths, taken, strict=True):
                mask = sum(1 << bit for b in span for bit in blocks[b])
                made.append(Part(mask - (1 << BITS) if mask >> (BITS - 1) else mask, width, t))
            found = (cost, [p for p in made if p.threshold >= 0])
    return found[1]


def _cooccurring(values: np.ndarray) -> np.ndarray:
    bits = _bits(values).astype(np.float64)
    return (bits.T @ bits).astype(np.int64)


def _block_values(values: np.ndarray, blocks: list[list[int]]) -> np.ndarray:
    bits = _bits(values).astype(np.int64)
    weights = 1 << np.arange(BLOCK)
    return np.stack([np.bincount(bits[:, b] @ weights, minlength=1 << BLOCK) for b in blocks])


# -- links ----------------------------------------------------------------------------------------


def _long(number: int) -> str:
    """A literal; the smallest long cannot be written as one."""
    return f"{number}L" if number > -(1 << 63) else "(-9223372036854775807L - 1L)"


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Pairs ``(u, v)`` of nodes whose fingerprints differ in at most ``distance`` bits, each once.

    ``fps`` has one row per node: ``node``, ``fp``.
    """
    parts, carried = planned(fps, distance), ["node", "fp"]

    def filed(prefix: str, near: bool) -> DataFrame:
        signatures = []
        for number, part in enumerate(parts):
            flips = ", ".join(map(_long, part.flips() if near else [0]))
            made = f"struct({number} AS part, (fp ^ f) & {_long(part.mask)} AS key)"
            signatures.append(F.expr(f"transform(array({flips}), f -> {made})"))
        rows = fps.select(*carried, F.explode(F.concat(*signatures)).alias("_s"))
        return rows.select("_s.part", "_s.key", *[F.col(c).alias(f"{prefix}_{c}") for c in carried])

    differing = "a_fp ^ b_fp"
    rules = ["a_fp <= b_fp", "a_node <> b_node", f"bit_count({differing}) <= {distance}"]
    for number, part in enumerate(parts[:-1]):  # only in the first part that finds the pair
        near = f"bit_count(({differing}) & {_long(part.mask)}) <= {part.threshold}"
        rules.append(f"NOT (part > {number} AND {near})")
    found = filed("a", False).join(filed("b", True), ["part", "key"]).filter(" AND ".join(rules))
    return found.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))


def linked(known: DataFrame, distance: int) -> DataFrame:
    """``known`` (``doc_id``, ``fp``; it is read more than once) with ``component_id``: the smallest id
    that links lead to, its own included.

    Equal fingerprints become one node before anything is compared, so copies cost one row per task.
    """
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    if nodes.isEmpty():
        none = nodes.select("fp", F.col("_least").alias("component_id")).limit(0)
        return known.join(none, "fp", "left")
    return _named(known, nodes, "fp", common.components(links(nodes, distance)))


def _named(known: DataFrame, nodes: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """``known`` with the smallest ``_least`` of all nodes in the component of its own as ``component_id``."""
    of_node = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = of_node.join(roots.select(F.col("root")).distinct(), "root", "left_semi")
    least = joined.groupBy("root").agg(F.min("_least").alias("_of_root"))
    final = of_node.join(least, "root", "left").select(
        key, F.coalesce("_of_root", "_least").alias("component_id")
    )
    return known.join(final, key)


def near_duplicates(
    docs: DataFrame, distance: int = 3, width: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``.

    Documents link when their fingerprints differ in at most ``distance`` bits. Texts without words
    (null among them) all have fingerprint 0. A null id never names a component that has another.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = common.written(fingerprinted(narrow, width=width).select("doc_id", "fp"), "documents-fp")
    return linked(known, distance).select("doc_id", "fp", "component_id")


def simhash_kept(
    docs: DataFrame, distance: int = 3, width: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` less every document whose component (:func:`near_duplicates`: fingerprints of
    ``width``-word shingles within ``distance`` bits, linked transitively) names a smaller id: one
    document of each group stays. Rows without id all stay; rows that repeat an id stand or fall
    together; other columns pass through unchanged."""
    found = near_duplicates(docs, distance, width, doc_id, text)
    gone = common.fresh(docs.columns, "_dropped")
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")


# -- similar sets ---------------------------------------------------------------------------------
#
# All pairs with a Jaccard similarity of at least t, by prefixes. Let all sets be in one order (any
# is right; shingles that are frequent in a sample come last, so few sets meet in what comes first).
# A set of n similar to one that is not larger shares at least t n with it, and 2 t / (1 + t) n with
# one that is not smaller; so the first n - t n + 1 of the larger and the first n - 2 t / (1 + t) n + 1
# of the smaller have a shingle in common. Pairs that meet are left out only by bounds that hold for
# every similar pair: sizes, and the bits in which the parities of hash values differ, which are at
# most the shingles that only one of both has.


def _digest(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def _reach(size: int, share: float) -> int:
    """How many shingles come first, where ``share`` of the set is in common."""
    return size - math.ceil(share * size - 1e-9) + 1 if size else 0


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in three documents of a sample, sorted, and in how many: the most frequent."""
    every = max(1, docs.count() // SAMPLE)
    rows = _shingled(docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0), width)
    counted = rows.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    most = counted.filter("n > 2").orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    values, counts = most["hash"].to_numpy().view(np.uint64), most["n"].to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def _prefixed(docs: DataFrame, similarity: float, width: int, words: int) -> DataFrame:
    """``docs`` (``text``) with ``size`` of the set of shingles, ``key`` (a digest of the set), ``marks``
    (the parity of its hashes by their last bits) and ``firsts`` (what comes first)."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))  # at most 1 MB

    def rows(texts):
        values, counts = frequent.value
        made = [], [], [], []
        for t in texts:
            own = np.unique(shingle_hashes(t or "", width))
            seen = np.zeros(len(own), dtype=np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                seen = np.where(values[at] == own, counts[at], 0)
            firsts = own[np.argsort(seen, kind="stable")[: _reach(len(own), similarity)]]
            bits = np.bincount((own % np.uint64(BITS * words)).astype(np.int64), minlength=BITS * words) & 1
            marks = np.packbits(bits.astype(bool), bitorder="little").view(np.int64)
            for column, value in zip(made, (len(own), _digest(own), marks, firsts.view(np.int64)), strict=True):
                column.append(value)
        return made

    outputs = "size int, key binary, marks array<bigint>, firsts array<bigint>"
    return common.extended(docs, {"text": F.col("text")}, outputs, rows).drop("text")


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (``text``) with ``hashes``, the distinct shingles of the whole text, and their ``key``."""

    def rows(texts):
        found = [np.unique(shingle_hashes(t or "", width)) for t in texts]
        return [[h.view(np.int64) for h in found], [_digest(h) for h in found]]

    return common.extended(docs, {"text": F.col("text")}, "hashes array<bigint>, key binary", rows).drop("text")


def _possible(similarity: float, words: int) -> str:
    """What holds for ``a_size``, ``a_marks``, ``b_size``, ``b_marks`` of similar sets."""
    apart = " + ".join(f"bit_count(a_marks[{i}] ^ b_marks[{i}])" for i in range(words))
    most = (1 - similarity) / (1 + similarity)
    sizes = f"least(a_size, b_size) >= {similarity!r}D * greatest(a_size, b_size) - 1e-6D"
    return f"{sizes} AND {apart} <= {most!r}D * (a_size + b_size) + 1e-6D"


def _ends(frame: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return frame.select("hash", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def similar_links(nodes: DataFrame, similarity: float, words: int, verified) -> DataFrame:
    """Similar pairs ``(u, v)`` that give the same components as all of them.

    ``nodes``: ``node``, ``size``, ``marks``, ``firsts``; ``verified`` writes the similar ones of pairs.
    First each node is compared with one for each shingle it has among its first ones, a node of the
    smallest component so far, as long as that gives a tenth of the links of the round before; then
    with all others that these links have not connected already. So a large group of near copies does
    not give all its pairs.
    """
    rows = nodes.select("node", F.posexplode("firsts").alias("at", "hash"))
    shared = rows.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    unsettled = common.written(rows.join(shared, "hash").withColumn("root", F.col("node")), "met")
    facts, links, count, before = nodes.select("node", "size", "marks"), None, 1, 0
    while count and count * 10 >= before:
        least = unsettled.groupBy("hash").agg(F.min("root").alias("_a"), F.min_by("node", "root").alias("v"))
        pairs = unsettled.join(least, "hash").filter("root <> _a").select(F.col("node").alias("u"), "v").distinct()
        for end, prefix in (("u", "a"), ("v", "b")):
            pairs = pairs.join(facts.toDF(end, f"{prefix}_size", f"{prefix}_marks"), end)
        new = verified(pairs.filter(_possible(similarity, words)).select("u", "v"))
        count, before = new.count(), count
        links = new if links is None else links.unionByName(new)
        rooted = unsettled.drop("root").join(common.components(links), "node", "left")
        rooted = rooted.withColumn("root", F.coalesce("root", "node"))
        several = rooted.groupBy("hash").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b")
        then = common.written(rooted.join(several.select("hash"), "hash"), "met")
        common.discard(unsettled)
        unsettled = then
    unsettled = unsettled.join(facts, "node")
    columns = ["node", "root", "size", "marks", "at"]
    share = 2 * similarity / (1 + similarity)
    short = f"b_at < b_size - ceil({share!r}D * b_size - 1e-9D) + 1"
    larger = "(b_size < a_size OR b_size = a_size AND b_node < a_node)"
    found = _ends(unsettled, "a", columns).join(_ends(unsettled, "b", columns).filter(short), "hash")
    found = found.filter(f"{larger} AND a_root <> b_root AND {_possible(similarity, words)}")
    second = verified(found.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct())
    return links.unionByName(second)


def similar_kept(
    docs: DataFrame,
    similarity: float = 0.8,
    width: int = 5,
    words: int = 8,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` less all but one document (the smallest id) of each group of near-duplicates: those
    with a Jaccard similarity of at least ``similarity`` (over 0) on shingles of ``width`` words.

    All pairs are found; ``words`` (64 bits of parities each) only saves comparisons. Equal sets
    become one node before anything is compared. Documents without words are no near-duplicates of
    anything; rows without id stay, as do all rows that repeat an id that stays.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    narrow = narrow.filter("doc_id IS NOT NULL")
    known = _prefixed(narrow, similarity, width, words).filter("size > 0")
    known = common.written(known, "documents-firsts")
    nodes = known.groupBy("key", "size", "marks", "firsts").agg(F.min("doc_id").alias("_least"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    keys = common.written(known.select("doc_id", "key"), "documents-sets")
    common.discard(known)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = common.written(pairs, "near-pairs")
        ends = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node")
        asked = nodes.join(ends, "node").select("node", F.col("_least").alias("doc_id"), F.col("key").alias("_key"))
        # Rows that repeat an id can have other texts.
        sets = _shingled(narrow.join(asked, "doc_id").select("node", "_key", "text"), width)
        sets = sets.filter("key = _key").select("node", "hashes").dropDuplicates(["node"])
        sets = common.written(sets, "shingles")
        a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
        b = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
        same = F.size(F.array_intersect("a", "b"))
        jaccard = same / (F.size("a") + F.size("b") - same)
        similar = pairs.join(a, "u").join(b, "v").filter(jaccard >= similarity).select("u", "v")
        similar = common.written(similar, "similar")
        common.discard(sets)
        return similar

    roots = common.components(similar_links(nodes, similarity, words, verified))
    groups = _named(keys, nodes.select("node", "key", "_least"), "key", roots)
    gone = common.fresh(docs.columns, "_dropped")
    dropped = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(dropped.distinct(), F.col(f"`{doc_id}`") == F.col(gone), "left_anti")

"""The queries of this subpackage, over whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicelane.llm import (
    embeddings,
    exact,
    langid,
    mixing,
    periodic,
    pieces,
    quality,
    shards,
    simhash,
    token_counts,
    token_files,
    url_rules,
    whitening,
)
from voicelane.llm.common import bound, new_path, table, written
from voicelane.plans.registry import Query

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, check: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return register


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(docs, PIECES).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay together."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    return shards.sharded(docs, 16, group="text_hash", size="size").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op4_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS chars,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
      doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER best AS kept, sha256(plain) AS text_sha256
    FROM d
    WINDOW best AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """For each document the one that stays of all with the same text."""
    found = exact.exact_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within three bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), distance=3, width=3)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op5_embedding_near_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Links between all vectors of a label from cosine 0.98 on."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"), least=0.98)


PAGE_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


@query("op6_url_filter")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts for all page URLs, by explicit rules and by rules mined from the labels."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return url_rules.judged(table(spark, folder, "pages"), labels, PAGE_RULES)


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = table(spark, folder, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = langid.train(docs.filter(rest != 1).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(rest == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, quantiles and truncated totals of all documents for every context limit."""
    docs = table(spark, folder, "documents").select("text")
    lengths = pieces.encode(docs, PIECES, decoded=False).select("n_tokens")
    return token_counts.limits(written(token_counts.histogram(lengths), "token-histogram"))


@query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written in files of compressed planes and read back from them."""
    out = new_path(spark, "token-planes")
    manifest = token_files.write(table(spark, folder, "documents"), out, WORDS, end=1)
    return token_files.read(manifest, out).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op10_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken for the target weights of the sources."""
    found = mixing.mix(table(spark, folder, "documents"), weights=[3, 1, 2], share=1.5, most=2.0)
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def _planted(text: F.Column, doc_id: F.Column) -> F.Column:
    """The text with a periodic tail in one document of ten: for ``h = crc32(doc_id)`` with ``h % 10 = 0``,
    word ``i >= a`` becomes word ``a + (i - a) % p``; ``a = g % n``, ``p = 1 + (n - a) / (3 + g % 8)``,
    ``g = h / 10`` (integer division). Words are joined by one space, which splits into the same words.
    The word array is bound once per row, so the split is not repeated for each word."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("bigint")

    def tail(words: F.Column) -> F.Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        moved = F.transform(
            words,
            lambda w, i: F.when(i >= a, F.element_at(words, (a + F.pmod(i - a, p) + 1).cast("int"))).otherwise(w),
        )
        return F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)) & (n > 0), F.array_join(moved, " "))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.coalesce(bound(words, tail), text)


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every whole text (a tenth of them given a periodic tail first), and the collapsed text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs.select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("q")))
    )
    listed = F.concat_ws(
        "", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period))
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best.s).alias("start"),
        best.l.alias("length"),
        (-best.q).alias("period"),
        F.floor(1000 * best.l / -best.q).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened top 16 components of every whole, finite embedding; each distinct vector fits once."""
    return whitening.whitened(table(spark, folder, "embeddings"), components=16, weighted=False)


@query(
    "op13_quality_rules",
    r"""
    WITH w AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    win AS (
      SELECT rid, j, array_to_string(words[j + 1:j + 8], ' ') AS s
      FROM (SELECT rid, words, unnest(range(0, len(words) - 7)) AS j FROM w WHERE len(words) >= 8) x),
    rep AS (
      SELECT rid, j FROM (SELECT rid, j, count(*) OVER (PARTITION BY rid, s) AS c FROM win) y WHERE c >= 2),
    cov AS (
      SELECT rid, count(DISTINCT j + k) AS n_repeat_words FROM rep, range(0, 8) r(k) GROUP BY rid),
    b AS (
      SELECT doc_id, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•*-]'))) AS bullets,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS lettered
      FROM w LEFT JOIN cov ON w.rid = cov.rid)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
        OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
        OR 10 * n_dup_lines > 3 * n_lines OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines
        OR 10 * lettered < 8 * n_words) AS kept
    FROM b
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the cascade's verdict for every whole text."""
    found = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

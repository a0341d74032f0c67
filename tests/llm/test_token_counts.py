import random

import pytest

from tests.llm import cases
from voicelane.llm import token_counts


@pytest.mark.parametrize("by", [[], ["source"]])
def test_limits_match_brute_force(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 5, 1023, 1024, 1025, rng.randrange(9_000)])) for _ in range(800)]
    frame = spark.createDataFrame([*rows, ("a", None)], "source string, n_tokens int")
    rows = [(s, n or 0) for s, n in [*rows, ("a", None)]]
    found = token_counts.limits(token_counts.histogram(frame, by), by)
    expected = set()
    for group in {s for s, _ in rows} if by else {None}:
        own = [n for s, n in rows if not by or s == group]
        for n in set(own):
            over, upto = [x for x in own if x > n], [x for x in own if x <= n]
            kept = sum(min(x, n) for x in own)
            expected.add((group, n, own.count(n), n * own.count(n), len(upto), sum(upto), len(over), sum(over), kept, sum(own) - kept, len(upto) / len(own)))
    if by:
        # Groups join on their key: a null group has no partner.
        expected = {e for e in expected if e[0] is not None}
        assert {tuple(r) for r in found.collect()} == expected
    else:
        assert {(None, *r) for r in found.collect()} == expected
        own = sorted(n for _, n in rows)
        for limit in (0, 3, 1_024, 100_000):
            assert token_counts.kept_at(found, limit).first()[0] == sum(min(n, limit) for n in own)
        for share in (0.1, 0.5, 1.0):
            assert token_counts.quantile(found, share).first()[0] == next(n for n in own if sum(x <= n for x in own) >= share * len(own))


def test_no_documents(spark):
    none = cases.documents(spark, []).selectExpr("1 AS n_tokens", "'clash' AS tokens")
    assert token_counts.limits(token_counts.histogram(none)).collect() == []


def test_query_counts_all_tokens(spark):
    import public_tokenizers
    import sentencepiece

    from voicelane.llm import catalog

    folder = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    lengths = [len(model.encode(t)) + 2 for t in texts]
    rows = catalog.QUERIES["op8_token_counts"](spark, folder).collect()
    assert {r["n_tokens"]: r["documents"] for r in rows} == {n: lengths.count(n) for n in lengths}
    assert max(r["kept_tokens"] for r in rows) == sum(lengths)

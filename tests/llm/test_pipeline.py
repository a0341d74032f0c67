import collections
import re

import numpy as np
import public_tokenizers
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import cases
from tests.llm.test_mixing import water
from tests.llm.test_simhash import fingerprint
from voicelane.llm import common

FOLDER = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, FOLDER, "documents")
    rows = [tuple(r) for r in docs.collect()]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.written(stage(spark, docs, FOLDER), name)
        results.append((docs.columns, [tuple(r) for r in docs.collect()]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixture", "encoding"]
    assert all(c == columns_of(spark) for c, _ in results[:-1]) and columns == columns_of(spark)
    language, exact, near, mixture, encoded = [r for _, r in results]
    # Language: every text with a letter stays.
    expected = sorted(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert sorted(language) == expected
    # Exact duplicates: of equal texts the longest, then the smallest id.
    groups = collections.defaultdict(list)
    for r in expected:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append((-len(r[1]), r[0], r))
    expected = sorted(min(g)[2] for g in groups.values())
    assert sorted(exact) == expected
    # Near-duplicates: SimHash components (3-word shingles, within 3 bits, transitive), smallest id stays.
    fps = {r[0]: fingerprint(r[1] or "", corpus_pipeline.SHINGLE_WORDS) for r in expected}
    values = np.array(sorted(set(fps.values())), dtype=np.uint64)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= corpus_pipeline.MOST_BITS):
            parent[find(i + 1 + int(j))] = find(i)
    place = {int(v): k for k, v in enumerate(values)}
    least = {}
    for doc, fp in fps.items():
        root = find(place[fp])
        least[root] = min(least.get(root, doc), doc)
    assert sorted(near) == sorted(r for r in expected if least[find(place[fps[r[0]]])] == r[0])
    # Mixture: whole rows, near the targets.
    sizes, taken = collections.Counter(), collections.Counter()
    for r in near:
        sizes[r[3]] += len(r[1].split())
    for r in mixture:
        taken[r[3]] += len(r[1].split())
    assert set(mixture) <= set(near) and max(collections.Counter(mixture).values()) <= 2
    for source, target in water(dict(sizes), corpus_pipeline.WEIGHTS, 1.5, 2.0).items():
        assert abs(taken[source] - target) <= 0.02 * target
    # Encoding: as the library does, row by row.
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in near}
    assert collections.Counter(r[0] for r in encoded) == collections.Counter(r[0] for r in mixture)
    for doc, _, count, ids, decoded in encoded:
        own = model.encode(texts[doc], add_bos=True, add_eos=True)
        assert (count, ids) == (len(own), b"".join(i.to_bytes(4, "little") for i in own))
        assert decoded == model.decode(own)


def columns_of(spark):
    return common.table(spark, FOLDER, "documents").columns


def test_edge_documents_pass_every_stage(spark):
    for rows in (cases.DOCS, []):
        extra = {"fp": "1", "copies": "2", "ids": "3", "score": "4", "spans": "5", "lang_pred": "'x'",
                 "_text": "'t'", "_dropped": "6", "_id": "7", "_copies": "8", "_copy": "9", "_c0": "10"}
        docs = cases.documents(spark, rows, extra)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.written(stage(spark, docs, FOLDER), name)
            assert out.columns == docs.columns
            assert all(r["score"] == 4 and r["_text"] == "t" and r["_c0"] == 10 for r in out.collect())
            docs = out
        assert (docs.count() > 0) == bool(rows)
        corpus_pipeline.encoding(spark, docs, FOLDER).collect()


def test_registered():
    names = entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert {"op4_exact_dedup"} <= set(entry.oracle_sql())


def test_language_without_labels_drops_only_letterless(spark):
    rows = [(1, "plain words here", None, "a", 1), (2, "1234 5678", None, "a", 1), (3, None, None, "b", 1),
            (4, "mots simples", None, "b", 1)]
    docs = cases.documents(spark, rows)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, FOLDER).collect())
    assert kept == [1, 4]

"""Scoring hooks, language identification, sequences and classifiers."""

from pyspark.sql import functions as F

from voicelane.operators import classifiers, encoding, language
from voicelane.operators import scoring as S

FOLDER = "/root/testdata/sf0.01"


def review_rows(spark):
    return spark.createDataFrame(
        [
            (1, "filthy seats", None, None),
            (2, "filthy seats", "positive", ["Open name"]),
            (3, "rude agent", "bad value", ["Cleanliness"]),
            (4, "great friendly staff", "mixed", None),
            (5, "neither", "negative", []),
        ],
        "database_id bigint, review string, sentiment string, categories array<string>",
    )


def test_only_unscored_rows_are_scored(spark):
    rows = {r["database_id"]: r for r in S.score_reviews(review_rows(spark)).collect()}
    assert (rows[1]["sentiment"], rows[1]["categories"]) == ("negative", ["Cleanliness"])
    assert (rows[2]["sentiment"], rows[2]["categories"]) == ("positive", ["Open name"])
    assert rows[3]["categories"] == ["Staff & Communication"]
    assert rows[4]["sentiment"] == "positive"
    assert (rows[5]["sentiment"], rows[5]["categories"]) == ("negative", [])
    assert [rows[i]["precomputed"] for i in range(1, 6)] == [False, True, False, False, True]


def test_model_scorer_gets_small_batches_of_unscored_prompts(spark):
    def load():
        def generate(prompts):
            assert len(prompts) <= 16
            if prompts[0].startswith("What"):
                return ["Positive." if "great" in p else "NEGATIVE" for p in prompts]
            return [f"Cleanliness, Nonsense, {len(prompts)}" for _ in prompts]

        return generate

    base = review_rows(spark)
    rows = base.unionByName(
        spark.range(100, 150).select(
            F.col("id").alias("database_id"),
            F.lit("more great text").alias("review"),
            F.lit(None).cast("string").alias("sentiment"),
            F.lit(None).cast("array<string>").alias("categories"),
        )
    )
    found = {r["database_id"]: r for r in S.score_reviews(rows, S.model_scorer(load)).collect()}
    assert found[1]["sentiment"] == "negative" and found[1]["categories"] == ["Cleanliness"]
    assert found[2]["categories"] == ["Open name"]
    assert found[120]["sentiment"] == "positive"


def test_enrichment_columns(spark):
    enriched = S.enrich_reviews(review_rows(spark), lambda text: F.lit("xx"))
    row = enriched.filter("database_id = 5").first()
    assert row["primary_category"] == "Staff & Communication" and row["categories"] == []
    assert enriched.columns == [
        "database_id", "language", "sentiment", "primary_category", "categories",
        "has_damage_claim", "has_hidden_fees", "has_upselling",
    ]


def test_split_and_union_lose_nothing(spark):
    done, waiting = S.split_precomputed(review_rows(spark))
    both = S.union_scored(done, waiting)
    assert sorted(r["database_id"] for r in both.collect()) == [1, 2, 3, 4, 5]
    assert {r["database_id"] for r in both.filter("precomputed").collect()} == {2, 5}


def test_language_accuracy_beats_the_majority(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) >= 20")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    detect = language.detector(language.language_profile(documents.filter(side == 0)))
    held_out = documents.filter(side == 1).select("lang", detect(F.col("text")).alias("found"))
    total = held_out.count()
    right = held_out.filter("lang = found").count()
    majority = held_out.groupBy("lang").count().agg(F.max("count")).first()[0]
    assert right / total > 0.95 > majority / total


def test_language_defaults_and_ties(spark):
    labelled = spark.createDataFrame([("ab", "xx"), ("ab", "aa")], "text string, lang string")
    detect = language.detector(language.language_profile(labelled))
    texts = ["", "123 !?", None, "zzz", "ab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in rows.orderBy("i").select(detect(F.col("t"))).collect()]
    assert found == ["en", "en", "en", "en", "aa"]


def test_language_in_small_slices_gives_the_same(spark, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profile = language.language_profile(documents)
    whole = documents.select("doc_id", language.detector(profile)(F.col("text")).alias("l"))
    expected = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(language, "SLICE_CHARS", 500)
    sliced = documents.select("doc_id", language.detector(profile)(F.col("text")).alias("l"))
    assert sorted(map(tuple, sliced.collect())) == expected


def test_language_by_search_gives_the_same_as_by_table(spark, monkeypatch):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profile = language.language_profile(documents)
    by_table = documents.select("doc_id", language.detector(profile)(F.col("text")).alias("l"))
    expected = sorted(map(tuple, by_table.collect()))
    monkeypatch.setattr(language, "DENSE_IDS", 1)
    by_search = documents.select("doc_id", language.detector(profile)(F.col("text")).alias("l"))
    assert sorted(map(tuple, by_search.collect())) == expected


def test_first_tokens_equal_a_slice_of_all(one):
    text = F.lit(" !a b, c d")
    for n in range(1, 7):
        row = one(encoding.first_tokens(text, n), F.slice(encoding.tokens(text), 1, n))
        assert row[0] == row[1]


def test_vocabulary_order_and_encoding(spark):
    examples = spark.createDataFrame(
        [(1, "b a b", "yes"), (2, "b C!", "no " * 200), (3, "", "")],
        "id int, input string, output string",
    )
    vocab = encoding.vocabulary(examples, ["input", "output"], size=4)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    # After the reserved ids come 256 for the bytes of words that are not in the vocabulary.
    assert ids == {"no": 259, "b": 260, "a": 261, "c": 262}
    rows = encoding.encode(examples, vocab).orderBy("id").collect()
    spelled = [encoding.FIRST_BYTE_ID + b for b in b"yes"]
    assert rows[0]["input_ids"] == [260, 261, 260, 1] and rows[0]["labels"] == [*spelled, 1]
    assert rows[0]["attention_mask"] == [1, 1, 1, 1]
    assert len(rows[1]["labels"]) == 128 and rows[1]["labels"][-1] == 1
    assert rows[2]["input_ids"] == [1]
    assert rows[0].asDict().keys() == {"id", "input_ids", "attention_mask", "labels"}


def test_whole_vocabulary_and_both_ways_to_look_up(spark):
    texts = ["b a b", "größe öl b", None, "", "x " * 600, "ü" * 300]
    rows = [(i, t, "a b ß") for i, t in enumerate(texts)]
    examples = spark.createDataFrame(rows, "id int, input string, output string").repartition(3)
    vocab = encoding.vocabulary(examples, ["input", "output"])
    counted = {}
    for _, text, label in rows:
        for token in f"{text or ''} {label}".lower().split():
            counted[token] = counted.get(token, 0) + 1
    order = sorted(counted, key=lambda t: (-counted[t], t.encode()))
    assert {r["token"]: r["id"] for r in vocab.collect()} == {t: 259 + i for i, t in enumerate(order)}
    for known in (vocab, vocab.filter("token IN ('a', 'x')"), vocab.limit(0)):
        carried = encoding.encode(examples, known).orderBy("id").collect()
        joined = encoding.encode(examples, known, max_carried_bytes=-1).orderBy("id").collect()
        assert carried == joined and len(carried) == len(rows)
        assert all(encoding.V.UNKNOWN_ID not in r["input_ids"] for r in carried)
        assert max(len(r["input_ids"]) for r in carried) == 512


def test_only_tokens_that_do_not_travel_are_joined(spark, monkeypatch):
    """Of a vocabulary too large to travel, the frequent tokens do; texts that repeat are no trouble."""
    texts = ["a a a b", "a b rare " + "a " * 40, "", None, "seldom a b", "seldom a b", "ü rare x"]
    rows = [(i, t, "a b") for i, t in enumerate(texts)] + [(90, "a b", "once"), (None, "once", None)]
    examples = spark.createDataFrame(rows, "id int, input string, output string").repartition(3)
    vocab = encoding.vocabulary(examples, ["input", "output"])
    asked, real = [], encoding._asked
    monkeypatch.setattr(encoding, "_asked", lambda *args: asked.append(real(*args)) or asked[-1])
    for known in (vocab, vocab.filter("token <> 'once'")):
        expected = encoding.encode(examples, known).orderBy("id").collect()
        assert not asked
        parted = encoding.encode(examples, known, max_carried_bytes=2 * 13)
        assert parted.orderBy("id").collect() == expected
        lost = sorted(r["token"] for r in asked.pop().collect())
        assert lost == ["once", "once", "rare", "rare", "seldom", "seldom", "x", "ü"]


def test_classifiers_learn_and_score(spark):
    good, bad = ("lovely spotless interior", "Cleanliness"), ("tyre exploded badly", "Vehicle Condition")
    rows = [
        (f"{text} number {i}", "positive" if name == "Cleanliness" else "negative", [name])
        for i in range(60)
        for text, name in (good, bad)
    ]
    labelled = spark.createDataFrame(rows, "review string, sentiment string, categories array<string>")
    models = classifiers.train(labelled)
    scored = models.score(spark.createDataFrame([(good[0],), (bad[0],)], "review string")).collect()
    assert [(r["raw_categories"], r["raw_sentiment"]) for r in scored] == [
        ("Cleanliness", "positive"),
        ("Vehicle Condition", "negative"),
    ]

import numpy as np
import pytest

from tests.llm import cases
from voicelane.llm import catalog, langid

EN = "the weather was lovely and we walked along the river until the evening came with all its quiet light"
DE = "das wetter war schön und wir gingen am fluss entlang bis der abend mit seinem ruhigen licht kam"
RU = "погода была прекрасной и мы гуляли вдоль реки пока не наступил вечер"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 4)]
    return langid.train(cases.documents(spark, rows + [(99, None, "xx", "s", 0), (98, "no label", None, "s", 0)]))


def spans(spark, model, text):
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return langid.predict(frame, model).first()


def test_mixed_text_is_cut_into_spans(spark, model):
    assert model.languages == ["de", "en", "ru"]
    text = f"{EN}. {DE}! {RU}"
    row = spans(spark, model, text)
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    assert [text[s["begin"] : s["end"]] for s in row["spans"]] == [EN, DE, RU]
    assert row["lang_pred"] == "en" and 0.3 < row["score"] < 0.5


def test_one_foreign_word_is_no_span(spark, model):
    row = spans(spark, model, EN.replace("river", "fluss"))
    assert [s["lang"] for s in row["spans"]] == ["en"] and row["score"] == 1.0


def test_script_decides_where_letters_are_unknown(spark, model):
    assert spans(spark, model, "ж щ ю")["lang_pred"] == "ru"
    assert spans(spark, model, "日本語")["lang_pred"] in model.languages


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores = rng.normal(size=(n, 3)) * 10
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = scores[np.arange(n), paths].sum(1) - 15.0 * (paths[:, 1:] != paths[:, :-1]).sum(1)
        best = langid.viterbi(scores)
        own = scores[np.arange(n), best].sum() - 15.0 * (best[1:] != best[:-1]).sum()
        assert own == pytest.approx(value.max())


def test_single_language_only_where_changing_cannot_pay():
    rng = np.random.default_rng(2)
    singles = 0
    for _ in range(300):
        scores = rng.normal(size=(40, 3)) * 3 + np.repeat(rng.normal(size=(4, 3)), 10, axis=0)
        label = langid._single(scores)
        if label is not None:
            singles += 1
            assert (langid.viterbi(scores) == label).all()
    assert 0 < singles < 300


def test_two_other_languages_can_share_a_text():
    """One change between two others has two leads against it."""
    assert langid._single(np.array([[0.0, -100.0, -10.0], [-100.0, 0.0, -10.0]])) is None
    rng = np.random.default_rng(3)
    singles = 0
    for _ in range(5_000):
        n = rng.integers(2, 11)
        cut = rng.integers(1, n)
        scores = rng.normal(size=(n, 3)) * 3
        scores[:cut] += rng.normal(size=3) * 6
        scores[cut:] += rng.normal(size=3) * 6
        label = langid._single(scores)
        if label is not None:
            singles += 1
            assert (langid.viterbi(scores) == label).all()
    assert 500 < singles < 5_000


def test_edge_documents(spark, model):
    docs = cases.documents(spark, extra={"lang_pred": "1", "SCORE": "2", "spans": "3"})
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(cases.DOCS)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) == letters and 0 <= r["score"] <= 1
        if not letters:
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
    assert langid.predict(cases.documents(spark, []), model).collect() == []


def test_nothing_learned(spark):
    nothing = langid.train(cases.documents(spark, []))
    assert nothing.languages == []
    assert langid.predict(cases.documents(spark), nothing).filter("lang_pred <> 'und'").count() == 0


def test_held_out_accuracy(spark):
    found = catalog.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.filter("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)

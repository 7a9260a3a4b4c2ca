import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from falloff.llm import langid

WORDS = {"en": "the of and with from house river winter market street number water children", "de": "der die das und mit von haus fluss winter markt strasse nummer wasser kinder", "fr": "le la les et avec de maison fleuve hiver marché rue nombre eau enfants"}


def corpus(n=900, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(WORDS))
        rows.append((k, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randrange(6, 40))), lang))
    return rows


def test_held_out_accuracy_and_calibration(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(docs, langid.fit(docs)).withColumn("held_out", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang_pred"] == r["lang"] for r in held])) < 0.1


def test_labels_of_held_out_documents_teach_nothing(spark):
    rows = corpus(300)
    lie = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 5 == 0 else lang) for k, t, lang in rows]
    a, b = (langid.fit(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, lie))
    assert a.labels == b.labels == ["de", "en", "fr"] and (a.weights == b.weights).all()


def test_no_text_no_letters_no_labels_and_clashing_columns(spark):
    rows = [*corpus(200), (1000, None, "en"), (1001, "", None), (1002, "123 !?", "en"), (1003, "the river " * 200_000, None), (None, "the house", "en"), (1004, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(got) == len(rows)
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "en" and 0 <= got[1003]["score"] <= 1
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(none, langid.fit(none)).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_slices_count_every_gram_once():
    text = "ab c" * 150_000
    at, count = langid.sparse(text)
    assert len(text) > 2 * langid.SLICE and count.sum() == 3 * (len(text) + 2) - 3
    short = langid.sparse("ab c")[1].sum()
    assert short == 6 + 5 + 4


def test_temperature_is_found_again_and_has_no_edge():
    r = np.random.default_rng(4)
    z = r.normal(size=(20_000, 4)) * 2
    p = np.exp(z - z.max(axis=1, keepdims=True))
    y = np.array([r.choice(4, p=x / x.sum()) for x in p])
    for t in (0.2, 1.0, 7.0):
        assert abs(langid.temperature(z * t, y) / t - 1) < 0.06
    apart = np.eye(4)[np.arange(400) % 4] * 30.0  # told apart without an error
    t = langid.temperature(apart, np.arange(400) % 4)
    score = 1 / (1 + 3 * np.exp(-30.0 / t))
    assert abs(score - 401 / 404) < 1e-4


def test_too_many_labels_are_refused(spark):
    import pytest

    docs = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, most=10)


def test_temperature_comes_from_models_of_halves(spark, monkeypatch):
    """The model learns from every sampled row, and its temperature from logits of rows that models of either half haven't seen."""
    rows = [(i, w * 3, lang) for i in range(80) for lang, w in (("a", f"alpha beta {i % 7} "), ("b", f"gamma delta {i % 5} "))]
    fitted, calibrated, own, heat = [], [], langid.ftrl, langid.temperature
    monkeypatch.setattr(langid, "ftrl", lambda some, n: fitted.append(len(some)) or own(some, n))
    monkeypatch.setattr(langid, "temperature", lambda z, y: calibrated.append(z.shape) or heat(z, y))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(fitted) == 3 and fitted[0] == fitted[1] + fitted[2] and abs(fitted[1] - fitted[2]) <= 1
    assert calibrated == [(fitted[0], 2)]

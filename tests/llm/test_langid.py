import random

import numpy as np

from vertexflow.llm import langid

SYLLABLES = {"en": "the th er on an re he in ed nd ing ly", "de": "sch ein ung heit der die und ge ver be ich", "fr": "eau oux ment tion les que ai ou re eux", "es": "cion os as ado que la el ar mente ue"}


def text(lang, rng, n=60):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_undetermined(spark):
    rng = random.Random(3)
    labelled = [(i, text(lang, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    special = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !!", None), (1003, text("fr", rng), None), (1004, "a", None), (None, text("es", rng), "es"), (5, labelled[5][1], "de")]
    docs = spark.createDataFrame([(*r, 7) for r in labelled + special], "doc_id long, text string, lang string, score int")
    rows = langid.identify(docs).collect()
    assert len(rows) == len(labelled) + len(special)
    truth = {i: lang for i, _, lang in labelled}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.98
    by = {r["doc_id"]: r for r in rows}
    assert {i: by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)} == {1000: "und", 1001: "und", 1002: "und", 1003: "fr"}
    assert by[None]["held_out"] and all(0 <= r["score"] <= 1 for r in rows)
    kept = langid.keep(docs)
    assert kept.columns == docs.columns and kept.where("text IS NULL OR text = ''").count() == 0 and kept.count() >= len(labelled)


def test_machines_are_not_trained_on_the_driver(spark, monkeypatch):
    """The sample of 27 MB and what its training held stayed in the driver's memory."""

    def refused(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(langid, "linear_svm", refused)  # in this process only
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, text(lang, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 20)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert {v for langs in model.languages.values() for v in langs} == set(SYLLABLES)
    assert model.predict(langid.features(text("fr", rng)))[0] == "fr"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(i, f"only one language {i}", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"en"}


def test_features_ignore_other_characters():
    a, b = langid.features("Hello, world 123!"), langid.features("hello  WORLD")
    assert np.allclose(a, b) and langid.features("...") is None and langid.features(None) is None
    assert abs(np.linalg.norm(langid.features("x" * 100_000)) - 1) < 1e-5

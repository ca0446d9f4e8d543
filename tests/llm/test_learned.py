"""Language identification and toxicity, by held-out accuracy."""

import random

from pyspark.sql import functions as F
from weftline.llm import langid, registry, toxicity
from weftline.llm.common import training_row


def test_language_of_held_out_documents(spark, sf):
    got = registry.op4_language_id(spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(lang, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() and got.where("score < 0 OR score > 1").isEmpty()


def test_mixtures(make):
    rng = random.Random(1)
    syllables = {"aa": "ka ko ki lu mo".split(), "bb": "sch tz ung eit erg".split(), "cc": "oix eau ueu aie ment".split()}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    docs = make([(i, text(k, 150), k) for i, k in enumerate(sorted(syllables) * 20)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.langs == ("aa", "bb", "cc")
    for first, second, part in (("aa", "bb", 0.7), ("cc", "aa", 0.6), ("bb", "bb", 1.0)):
        lang, score, shares = langid.infer(model, text(first, int(300 * part)) + " " + text(second, round(300 * (1 - part))))
        assert lang == first and (score == 1 if first == second else 0.4 < score < 0.95)
        assert sum(s > 0 for s in shares) == (1 if first == second else 2)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(odd_docs, model, ["doc_id"]).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[6].lang_pred == "fr"
    none = langid.fit(no_docs, F.lit(True))
    assert langid.predict(no_docs, none, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, none, ["doc_id"]).collect()} == {"und"}


def abusive(rng, n):
    clean = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randint(20, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["zwirk", "zwirker", "zwirks", "quoxen", "quoxy"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    return rows, labels


def test_toxicity_of_held_out_documents(make):
    rows, labels = abusive(random.Random(2), 900)
    docs, labels_ = make(rows), make(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels_, training_row())
    got = toxicity.predict(docs, model, ["doc_id"]).withColumn("held", ~training_row()).where("held").collect()
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in got) >= 0.98 * len(got)
    assert any(e.startswith("^zwir") or e.startswith("=zwir") for e in model.lexicon)


def test_label_model_weighs_voters():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    vote = lambda right: np.where(rng.random(2000) < right, y, ~y).astype(int)
    copied = vote(0.7)
    votes = np.stack([vote(0.9), vote(0.55), copied, copied, copied], axis=1)
    p, accuracy, alone = toxicity.label_model(votes, np.where(rng.random(2000) < 0.95, y, ~y).astype(int))
    assert accuracy[0] > 0.85 and accuracy[1] < 0.65 and (alone[2:] < 0.6).all() and alone[0] > 0.7
    assert ((p > 0.5) == y).mean() > 0.93


def test_toxicity_of_odd_rows(odd_docs, no_docs, make):
    for labels in ([], [(4, 0), (5, 0)], [(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (7, 3)]):
        model = toxicity.fit(odd_docs, make(labels, "doc_id long, toxic int"), F.lit(True))
        got = toxicity.predict(odd_docs, model, ["doc_id"]).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.predict(no_docs, model, ["doc_id"]).count() == 0


def test_fit_is_bounded_after_the_join(make, monkeypatch):
    """One labelled id on two thirds of the rows, with texts of its own and copies: no more than ``rows`` different texts are learned from."""
    docs = [(1, f"text {i % 900} bad word{i % 7}") for i in range(2000)] + [(i, f"good text {i}") for i in range(2, 1002)] + [(None, "bad")]
    labels = [(1, 1, 1), (1, 1, 0), *((i, 1, 0) for i in range(2, 1002)), (None, 1, 1)]
    seen = []
    real = toxicity.train_linear
    monkeypatch.setattr(toxicity, "train_linear", lambda x, d, *more: seen.append(len(x)) or real(x, d, *more))
    model = toxicity.fit(make(docs), make(labels, "doc_id long, quality int, toxic int"), F.lit(True), rows=300)
    assert seen == [300]
    assert model.score("text 5 bad word3") > model.score("good text 7")
    toxicity.fit(make(docs), make(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert seen[1] == len({t for d, t in docs if d is not None})

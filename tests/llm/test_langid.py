import numpy as np
from pyspark.sql import functions as F

from tesselink.llm import langid, queries

from . import cases


def test_held_out_accuracy(spark, sf_dir):
    out = queries.op6_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95


def test_cases(spark):
    docs = cases.frame(spark)
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    out = langid.identify(docs, model).collect()
    assert len(out) == len(cases.rows())
    for r in out:
        none = not r["text"] or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and r["kept"] == "clash"


def test_blocks_do_not_change_the_counts(monkeypatch):
    text = cases.texts()[9]
    whole = np.bincount(np.concatenate(list(langid._grams(text))), minlength=langid.ROWS)
    monkeypatch.setattr(langid, "_BLOCK", 101)
    assert (np.bincount(np.concatenate(list(langid._grams(text))), minlength=langid.ROWS) == whole).all()


def test_scores_follow_the_formula():
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y"], rng.normal(size=(langid.ROWS, 2)).astype(np.float32), np.log([0.5, 0.5]))
    texts = ["abc def", "été", None, "7", "q" * 50]
    lang, score = model.score(texts)
    for t, g, s in zip(texts, lang, score):
        rows = [x for part in (langid._grams(t) if t else ()) for x in part]
        if not rows:
            assert (g, s) == ("und", 0.0)
            continue
        logs = [sum(float(model.matrix[r, k]) for r in rows) + np.log(0.5) for k in (0, 1)]
        p = 1 / (1 + np.exp(min(logs) - max(logs)))
        assert g == model.languages[int(np.argmax(logs))] and abs(s - p) < 1e-6


def test_without_labels_and_empty(spark):
    docs = cases.frame(spark)
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(cases.empty(spark), langid.train(cases.empty(spark))).count() == 0


def test_numbers_are_no_letters():
    assert not list(langid._grams("x² + ½".replace("x", ""))) and not list(langid._grams("12 ² ½ Ⅷ _ !")) and list(langid._grams("x²"))

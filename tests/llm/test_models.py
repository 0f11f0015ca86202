import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import quality, toxicity
from listwright.llm.labelled import held_out, labelled_sample
from listwright.llm.quality import QualityModel, decompose, fit_quality, quality_score, terms
from listwright.llm.toxicity import ToxicityModel, fit_toxicity, fold, toxicity_score
from tests.conftest import SF


def auc(score, y):
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(score, y, strict=True) if p for b, q in zip(score, y, strict=True) if not q]
    return float(np.mean(pairs))


def test_held_out_and_sample(spark, docs, labels):
    rows = spark.createDataFrame([(k,) for k in [None, *range(200)]], "doc_id long").select("doc_id", held_out().alias("x")).collect()
    assert all(r["x"] == (crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0) for r in rows)
    few = labelled_sample(docs, labels, "quality", 7).collect()
    assert len(few) == 7 and all(crc32(str(r["doc_id"]).encode()) % 5 for r in few)
    assert sorted(few) == sorted(labelled_sample(docs.repartition(5), labels.repartition(3), "quality", 7).collect())


def test_sample_of_odd_labels(spark, docs):
    odd = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, "x"), (2, None, "x"), (3, 7, "x"), (8, 0, "x")], "doc_id long, quality int, text string")
    kept = {r["doc_id"]: r["label"] for r in labelled_sample(docs, odd, "quality", 100).collect()}
    assert kept == {k: v for k, v in {1: 1, 8: 0}.items() if crc32(str(k).encode()) % 5}


def test_terms_depend_on_the_text_alone(docs):
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", "a", "é" * 700_000, "b " * 600_000]
    whole = terms(texts)
    assert all((terms([x])[0] == row).all() for x, row in zip(texts, whole, strict=True))
    ref = {}
    data = texts[0].lower().encode()
    for k in range(len(data) - 2):
        ref[data[k : k + 3]] = ref.get(data[k : k + 3], 0) + 1
    assert whole[0, : quality.TRIGRAM_BINS].sum() == sum(ref.values())


def test_decomposition():
    x = np.random.default_rng(0).normal(size=(60, 5)).astype(np.float32) @ np.random.default_rng(1).normal(size=(5, 80)).astype(np.float32)
    basis = decompose(x, 5)
    assert np.allclose(basis.T @ basis, np.eye(5), atol=1e-3) and np.allclose(x @ basis @ basis.T, x, atol=1e-2)


def test_votes_equal_brute_force(docs, labels):
    model = fit_quality(docs, labels)
    texts = [r["text"] for r in docs.limit(30).collect()]
    latent = model.latent(terms(texts)).astype(float)
    for z, got in zip(latent, model.score(texts), strict=True):
        near = model.vectors.astype(float) @ z
        best = np.argsort(-near)[: quality.NEIGHBOURS]
        votes = np.maximum(near[best], 0) ** quality.SHARPNESS
        share = np.clip((votes * model.labels[best]).sum() / votes.sum(), 0.01, 0.99)
        want = 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * np.log(share / (1 - share)))))
        assert got == pytest.approx(want, abs=0.02)


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op3_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in test], [truth[r["doc_id"]] for r in test]) >= 0.9


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc([r["score"] for r in test], [truth[r["doc_id"]] for r in test]) >= 0.95
    clean = [r for r in test if not truth[r["doc_id"]]]
    assert np.mean([r["predicted"] for r in clean]) <= 0.03


def test_folding():
    assert fold("1D10T, ѕtuріd! M0r0n").split()[0] == "idiot"
    assert "stupid" in fold("ѕtuріd.") and "moron" in fold("M0r0n") and "idiot" in fold("ÍDÏÒT")


def test_signs_are_letters_only_inside_words():
    assert fold("Shut up!") == fold("Shut up.") and fold("trash can! 100 4").split() == ["trash", "can"]
    assert fold("sh!t $hut @sshole f00l").split() == ["shit", "shut", "asshole", "fool"]


def test_every_seed_counts(docs, labels):
    model = fit_toxicity(docs, labels)
    texts = ["", *toxicity.SEEDS, "kill yourself you bastard", "Shut up!", "Shut up."]
    score = model.score(texts)
    assert (score[1:] > score[0]).all() and score[-1] == score[-2]
    assert model.score(["the trash can is full"])[0] == score[0]


def test_many_hits_in_a_long_text():
    model = ToxicityModel({" trash": 2.0, " idiot": 3.0}, frozenset({" trash can "}))
    start = time.perf_counter()
    assert len(model.found(fold("trash can " * 1_000_000 + "idiot trash"))) == 2
    assert time.perf_counter() - start < 20


def test_lexicon_equals_brute_force(docs):
    model = ToxicityModel({" idio": 2.0, " idiot": 3.0, " the ": 1.0, " hate you ": 4.0}, frozenset({" idiot proof "}))
    assert {w for w, _ in model.found(fold("An idiot. Idiotic!")).values()} == {3.0}
    assert len(model.found(fold("An idiot. Idiotic! video"))) == 2
    assert model.found(fold("It is idiot proof, I say")) == {}
    assert sum(w for w, _ in model.found(fold("I hate you, the idiot-proof idiot")).values()) == 8.0
    for text in [r["text"] for r in docs.limit(50).collect()]:
        folded, total = fold(text), 0.0
        for start in [k for k, x in enumerate(folded) if x == " "]:
            total += max([w for t, w in model.weights.items() if folded.startswith(t, start)], default=0.0)
        assert sum(w for w, _ in model.found(folded).values()) == pytest.approx(total)


def test_exceptions_and_terms_are_learned(spark):
    rows, marks = [], []
    for k in range(400):
        toxic = k % 4 == 0
        rows.append((k, f"w{k * 7} w{k * 11} some text " + (f"you grumblo{'abcde'[k % 5]} w{k} there" if toxic else f"a grumbloa bird w{k} there" if k % 3 == 0 else "") + f" w{k * 13}"))
        marks.append((k, int(toxic)))
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), exceptions=())
    assert any(x.startswith(" grum") for x in model.weights)
    assert any("grumbloa bird" in x for x in model.exceptions)
    score = model.score(["you grumblob there", "a grumbloa bird there", "nothing at all"])
    assert score[0] > 0.5 > score[1] >= score[2]


@pytest.mark.parametrize("fit, score", [(fit_quality, quality_score), (fit_toxicity, toxicity_score)])
def test_awkward_rows(spark, docs, labels, awkward, nothing, fit, score):
    model = fit(docs, labels)
    rows = awkward.withColumn("own", score(model)).collect()
    assert len(rows) == awkward.count() and all(0 <= r["own"] <= 1 for r in rows)
    assert rows[0]["own"] == rows[1]["own"]
    assert {r["own"] for r in rows if not r["text"]} == {rows[3]["own"]}
    assert nothing.select(score(model)).count() == 0
    none = fit(awkward, labels.limit(0))
    assert all(0 <= r[0] <= 1 for r in awkward.select(score(none)).collect())
    assert all(0 <= r[0] <= 1 for r in awkward.select(score(fit(nothing, labels))).collect())


def test_model_without_rows():
    empty = QualityModel(np.ones(quality.TERMS, np.float32), np.zeros((quality.TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    assert empty.score(["a", ""]).tolist() == [0.5, 0.5]
    assert F is not None

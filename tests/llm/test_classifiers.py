import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality_model, toxicity
from tidemark.llm.queries import op3_quality_classifier, op5_language_id, op7_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_language_of_held_out_documents(spark, docs):
    found = op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_language_edges(spark):
    model = langid.train(spark.createDataFrame([("the house and the tree", "en"), ("das haus und der baum", "de")] * 30, "text string, lang string"))
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "der baum " * 30000), (None, "the tree"), (5, "東京")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "de" and got[None][0] == "en" and got[5][0] in ("de", "en")
    none = langid.train(frame.limit(0).select("text", F.lit("x").alias("lang")))
    assert {r.lang_pred for r in langid.predict(frame, none).collect()} == {"und"}


def test_held_out_is_not_learned_from(spark, docs):
    folds = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).alias("f"))
    assert langid.learning(docs).join(folds.where("f = 2"), "doc_id").count() == 0


def test_toxicity_of_held_out_documents(spark, labels):
    found = op7_toxicity(spark, SF).join(labels, "doc_id").toPandas()
    assert found.score.between(0, 1).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()
    clean, toxic = found[found.held_out & (found.toxic == 0)], found[found.held_out & (found.toxic == 1)]
    assert (toxic.predicted == 1).mean() > 0.7
    assert (clean.predicted == 0).mean() > 0.95
    assert found[(found.toxic == 1)].score.mean() > 5 * found[found.toxic == 0].score.mean()


def test_disguised_words_are_restored(spark):
    plain = ["the house stands on the hill", "rain falls on the tree and the hill", "she said that it was late in the day", "people walk along the river"]
    bad = ["stupid", "idiot", "moron", "loser", "worthless"]
    texts = [f"{plain[i % 4]} {bad[i % 5]} {plain[(i + 1) % 4]}" for i in range(400)] + [f"{plain[i % 4]} and {plain[(i + i // 4) % 4]}" for i in range(800)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    language = toxicity.language_model(frame)
    assert np.isfinite(language).all()
    decoder = toxicity.Decoder(language)
    for word, want in (("1d10t", "idiot"), ("st*pid", "stupid"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("house.", "house"), ("idiot###", "idiot")):
        assert toxicity.restored(word, decoder) == [want], word
    labels = spark.createDataFrame([(i, 1 if i < 400 else 0) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    probe = spark.createDataFrame([(1, "people said 1d10t"), (2, "rain on the hill"), (3, "the river i d i o t"), (4, None), (5, ""), (None, "the moron walks"), (7, "x1" * 20000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] > 0.5 and got[None] > 0.5 and got[4] == got[5] < 0.5
    kept = toxicity.keep_clean(probe.withColumn("score", F.lit("own")), model).collect()
    assert {r.doc_id for r in kept} >= {2, 4, 5} and not {r.doc_id for r in kept} & {1, 3, None} and kept[0].score == "own"
    assert toxicity.train(frame, labels.where("toxic = 0")).bias is None


def test_quality_against_labels(spark, labels):
    found = op3_quality_classifier(spark, SF).join(labels, "doc_id").toPandas()
    assert found.score.between(0, 1).all()
    assert found[found.quality == 1].kept.mean() > 0.95 and found[found.quality == 0].kept.mean() < 0.1


def test_em_recovers_labeller_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = [0.9, 0.8, 0.75, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 1, np.where((rng.random(len(truth)) < p) == truth, 2, 0)) for p in right], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, table = quality_model.expectation_maximisation(patterns, counts.astype(float))
    for k, p in enumerate(right):
        assert abs(table[k, 1, 2] / (table[k, 1, 2] + table[k, 1, 0]) - p) < 0.05
    assert good[(patterns == 2).all(1)][0] > 0.95 and good[(patterns == 0).all(1)][0] < 0.1


def test_one_text_many_times_gives_one_of_the_sample(spark):
    many = spark.range(100_000).select(F.lit("the same text again").alias("text"), F.lit("en").alias("lang")).union(spark.createDataFrame([("der baum", "de"), ("das haus", "de")] * 20, "text string, lang string"))
    assert langid.train(many, per_lang=1000).predict("das haus der baum")[0] in ("de", "en")
    assert quality_model.train(many, sample=1000).shape[1] == 2


def test_quality_edges(spark):
    frame = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "some words here", 5)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in quality_model.score(frame, quality_model.train(frame)).collect()}
    assert got[1].score == got[2].score == 0.0 and not got[1].kept and None in got
    assert quality_model.score(frame.limit(0), quality_model.train(frame.limit(0))).count() == 0


def test_doubled_signs_and_masks_are_restored(spark):
    texts = ["the pussy cat and the maggot", "he will shoot the class bass", "kill the bull at the hill", "she has a fuck and a duck", "a good book on a hook"] * 50
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.language_model(frame))
    for word, want in (("pu55y", "pussy"), ("sh00t", "shoot"), ("ma99ot", "maggot"), ("cla$$", "class"), ("ki||", "kill"), ("f**k", "fuck"), ("g00d!!", "good"), ("h00k***", "hook"), ("c4t", "cat")):
        assert toxicity.restored(word, decoder) == [want], word
    assert len(decoder.best("a" + "*" * 20000 + "b")) < 10

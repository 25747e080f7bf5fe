"""Quality scores and languages: held-out accuracy, and defined results for odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, quality
from plumbline.llm.common import held_out
from plumbline.llm.queries import op1_quality_classifier, op2_language_id
from tests.llm.cases import clashing, collected, rows, table

GIVEN = "/root/testdata/sf0.01"


def test_held_out_is_the_given_fold(spark):
    found = spark.range(300).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in found)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(held_out(F.col("id"))).first()[0] is False


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{GIVEN}/labels.parquet").select("doc_id", "quality")
    found = op1_quality_classifier(spark, GIVEN).join(labels, "doc_id").toPandas()
    assert ((found["score"] >= 0) & (found["score"] <= 1)).all()
    assert (found["predicted"] == (found["score"] >= 0.3)).all()
    out = found[found["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.95
    good, bad = out[out["quality"] == 1]["score"], out[out["quality"] == 0]["score"]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_uses_labels_outside_the_fold_only(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    labels = spark.read.parquet(f"{GIVEN}/labels.parquet")
    model = quality.fit(docs, labels)
    flipped = labels.withColumn(
        "quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    other = quality.fit(docs, flipped)
    assert np.array_equal(model.weights, other.weights) and model.bias == other.bias


def test_quality_of_odd_tables(spark):
    docs = clashing(table(spark), "score", "doc", "quality", "x")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, none)
    scored = quality.score_documents(docs, model).select("score").collect()
    assert [r["score"] for r in scored] == pytest.approx([quality.CUT] * len(rows()))
    one_sided = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    assert not quality.fit(docs, one_sided).weights.any()
    both = spark.createDataFrame([(7, 1), (8, 1), (9, 0), (13, 0), (999, 0), (9, 1)], "doc_id bigint, quality int")
    accepted = quality.accepted(docs, quality.fit(docs, both))
    assert accepted.columns == docs.columns
    assert quality.accepted(docs.limit(0), model).collect() == []


def test_preferences_order_features():
    generator = np.random.default_rng(0)
    good, bad = generator.normal(0.5, 1, (300, 6)), generator.normal(0, 1, (200, 6))
    weights = quality.bradley_terry(good, bad, 10, 1e-3, 1)
    assert np.mean((good @ weights)[:, None] > (bad @ weights)[None, :]) > 0.75


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "lang")
    found = op2_language_id(spark, GIVEN).join(docs, "doc_id").toPandas()
    out = found[found["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_languages_of_odd_tables(spark):
    docs = clashing(table(spark), "x", "machine", "score")
    found = language.predict_languages(docs, language.fit(docs)).collect()
    assert len(found) == len(rows())
    expected = [
        (d, *(("en", 1.0) if any(map(str.isalpha, t or "")) else ("und", 0.0))) for d, t, *_ in rows()
    ]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.predict_languages(docs, nothing).collect()} == {"und"}
    assert language.predict_languages(docs.limit(0), nothing).collect() == []


def test_families_then_languages(spark):
    words = {"en": "the house", "de": "das haus", "fr": "la maison", "xx-Q": "zuz kik", "es": "la casa"}
    data = [(i, words[lang], lang, None, None) for i, lang in enumerate([*words] * 30)]
    model = language.fit(table(spark, data))
    assert set(model.families) == {"germanic family", "romance family", "xx family"}
    assert len(model.pairs) == 3 + 1 + 1
    found = collected(language.predict_languages(table(spark, data), model), "doc_id", "lang_pred")
    assert found == sorted(((i, lang) for i, _, lang, *_ in data), key=repr)


def test_machine_separates():
    generator = np.random.default_rng(3)
    x = generator.normal(0, 1, (400, 10)).astype(np.float32)
    sign = np.sign(x[:, 0] + 0.5 * x[:, 1] - 0.2)
    weights = language.train_machine(x, sign, 10.0, 50, 1)
    assert np.mean(np.sign(x @ weights[:-1] + weights[-1]) == sign) > 0.97


def test_long_text_is_described_in_pieces(monkeypatch):
    text = "une maison très claire, des fleurs. " * 300
    whole = language.describe(text)
    monkeypatch.setattr(language, "_PIECE", 1000)
    assert float(whole @ language.describe(text)) > 0.999

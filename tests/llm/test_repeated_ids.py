"""Null and repeated ids, extreme values and thin labels in the corpus operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.llm import cotrain, hnsw, langid, licenses, queries, simhash
from tests.check import compare, connect

VECTORS = "vec_id long, embedding array<double>, node long, v string, name string"


def near(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "v", "n") for i, v in rows], VECTORS)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(df, min_shards=2).collect()), key=repr)


def test_vectors_that_share_an_id(spark):
    a, b = np.array([1.0, 0, 0, 0]), np.array([0, 1.0, 0, 0])
    rows = [(5, a), (5, b), (6, a + 0.01), (7, b + 0.01), (8, b + [0, 0, 0.02, 0]), (9, a)]
    got = near(spark, [(i, v.tolist()) for i, v in rows])
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 2, 5, False)]


def test_vectors_without_id_and_of_extreme_length(spark):
    rows = [(None, [1.0, 0.0]), (3, [1e200, 0.0]), (4, [0.0, 1e-200]), (2, [0.0, 1e200]), (None, [5.0, 5.0]), (1, [float("nan"), 1.0])]
    assert near(spark, rows) == sorted(
        [(None, 1, 3, False), (3, 1, 3, True), (4, 1, 2, False), (2, 1, 2, True), (None, 0, None, False), (1, 0, 1, True)], key=repr)


def test_fingerprints_link_through_a_null_id(spark, monkeypatch):
    df = spark.createDataFrame([(3, 0), (None, 0b1111), (8, 0b11111111), (8, -1), (1, -2)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: df)
    got = sorted((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 15, 3), (1, -2, 1), (3, 0, 3), (8, -1, 1), (8, 255, 3)]


def test_few_labels_of_a_class_still_count(spark):
    words = {0: "plain calm report of the garden and the river ", 1: "grabbix foul grabbix vile "}
    rows = [(i, words[int(i < 8)] * (3 + i % 5), "s", "en", 100) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, int(i < 8)) for i in range(150)] + [(160, None, 0), (161, 1, None), (162, None, None)],
                                   "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, labels)
    assert all(t.text is not None for t in model.targets.values())
    out = {r["doc_id"]: r["toxic_score"] for r in cotrain.score(docs, model).collect()}
    assert min(out[i] for i in range(8)) > 0.5 > max(out[i] for i in range(8, 200))


def test_folds_reach_every_class():
    rows = [{"key": i, "toxic": 1 if i < 2 else None if i > 90 else 0} for i in range(100)]
    train, check, pool = cotrain.folds(rows, "toxic")
    assert sorted(train + check + pool) == list(range(100)) and pool == list(range(91, 100))
    assert {0, 1} == {rows[i]["toxic"] for i in train} == {rows[i]["toxic"] for i in check}


def test_a_repeated_id_is_sampled_once(spark):
    docs = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
                                   F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    assert langid.training_rows(docs, 5, "doc_id", "text", "lang").count() == 1
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = cotrain._columns(docs, "doc_id", "text", "source", "lang", "n_chars")
    assert cotrain.sample(rows, labels, 5, 5).count() == 1


@pytest.mark.parametrize("name", ["op4_license_scan", "op13_spelling_variants"])
def test_query_equals_sql(spark, name):
    message, rows, _, _ = compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), queries.ORACLES[name])
    assert message is None and rows > 0


def test_null_ids_and_long_texts_in_licences(spark):
    text = "x " * 60000 + "Under the MIT license"
    docs = spark.createDataFrame([(None, text), (1, text), (1, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_base"], r["first_word"] or 0, r["labels"]) for r in licenses.summary(licenses.scan(docs)).collect())
    assert got == [(0, 1, 60000, "mit"), (1, 0, 0, ""), (1, 1, 60000, "mit")]

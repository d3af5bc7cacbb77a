import zlib

import numpy as np

from blockloom.llm import language, quality
from tests.llm.fixtures import AWKWARD, documents, folder


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op1_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.op1_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = np.mean([p == q for p, q in out])
    assert right > 0.95 > max(np.mean([q for _, q in out]), 0)


def test_rules_compile_to_the_same_scores(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert 0 < len(model.rules) < 200
    rows = quality.with_statistics(docs).select("_statistics.*", model.column().alias("score")).toPandas()
    assert np.allclose(model.scores(rows[model.names].to_numpy(float)), rows["score"])


def test_op1_awkward(spark, tmp_path):
    docs = documents(spark, AWKWARD)
    for name, labels in (("none", []), ("one", [(2, 1, 0), (3, 1, 0)]), ("both", [(i, i % 2, 0) for i in range(12)] * 2 + [(5, None, None), (None, 1, 0)])):
        d = folder(tmp_path / name, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        rows = {r.doc_id: r for r in quality.op1_quality(spark, d).collect()}
        assert len(rows) == len(AWKWARD) and rows[3].score == rows[4].score and all(0 <= r.score <= 1 for r in rows.values())
    d = folder(tmp_path / "empty", documents=docs.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.op1_quality(spark, d).count() == 0


def test_op5_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = language.op5_language_id(spark, d).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(langs)
    out = [(r.lang_pred == langs[r.doc_id], r.score) for r in rows if r.held_out and langs[r.doc_id]]
    right = np.mean([x for x, _ in out])
    assert right > 0.98 and abs(right - np.mean([s for _, s in out])) < 0.05  # calibrated


def test_op5_weights_are_sparse_and_rows_repeat(spark, tmp_path):
    d = folder(tmp_path, documents=documents(spark, AWKWARD + ["der die das und ist nicht"] * 20 + ["the and is not with that"] * 20))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language.train(language.learnable(docs))
    assert (model.weights == 0).mean() > 0.9
    rows = {r.doc_id: r for r in language.op5_language_id(spark, d).collect()}
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (0, 1, 2))
    assert rows[3].score == rows[4].score and rows[20].lang_pred == rows[21].lang_pred
    e = folder(tmp_path / "empty", documents=docs.limit(0))
    assert language.op5_language_id(spark, e).count() == 0


def test_whole_texts_count():
    model = language.Model(["a", "b"], np.zeros((language.FEATURES, 2), dtype=np.float32), np.zeros(2))
    long = "ab cd " * 300_000
    bins = language.grams(long + "zzz")
    assert len(bins) > 3_000_000 and set(language.grams("zzz").tolist()) <= set(bins.tolist())
    assert model.predict([long])[0] == ["a"]

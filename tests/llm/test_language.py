from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language

FOLDER = "/root/testdata/sf0.01"


def slow_counts(text: bytes) -> np.ndarray:
    out = np.zeros(language.DIMENSIONS)
    c = [int(language._FOLD[b]) for b in text]
    for a, b, d in zip(c, c[1:], c[2:]):
        if (a or b) and (b or d):
            out[((((a * 155 + b) * 155 + d) * 2654435761) % 2**32) >> 20] += 1
    return out


def test_counts_equal_a_plain_loop():
    texts = [b"", b"a", b"Hello  World 12, ok", "Übermäßig çà".encode(), b"ab" * 700_000, b"the end"]
    got = language.trigram_counts(texts)
    for t, row in zip(texts, got):
        assert (row == slow_counts(t)).all()


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame(
        [(5001, None, "en"), (5002, "", "de"), (5003, "12 %% 7", "fr"), (5004, "the thing", None), (None, "les de le", "fr"), (5006, "東", None)],
        "doc_id long, text string, lang string",
    ).withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    both = docs.unionByName(extra)
    got = language.predictions(both).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == both.count()
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 150
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (5001, 5002, 5003))
    assert all(by_id[i].lang_pred in ("en", "de", "fr", "es") for i in (5004, None, 5006))
    assert by_id[5006].rejected
    assert sum(r.rejected for r in got) < 0.01 * len(got) + 5


def test_prediction_ignores_everything_but_the_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()), rows_per_lang=50)
    a = docs.select("doc_id", "text", "lang")
    b = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    x = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(a, model, ["doc_id"]).collect()}
    y = {r.doc_id - 1: (r.lang_pred, r.score) for r in language.identify(b, model, ["doc_id"]).collect()}
    assert x.keys() == y.keys()
    assert all(x[k][0] == y[k][0] and abs(x[k][1] - y[k][1]) < 1e-6 for k in x)


def test_sample_is_bounded_even_if_all_ids_are_equal(spark):
    df = spark.range(300).select(F.lit(1).alias("doc_id"), F.concat(F.lit("word number "), "id").alias("text"), F.lit("en").alias("lang"))
    model = language.fit(df, rows_per_lang=20)
    assert model.langs == ["en"] and len(model.centroids) <= language.CLUSTERS


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predictions(df).collect()} == {"und"}
    assert language.predictions(df.limit(0)).collect() == []

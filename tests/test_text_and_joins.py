import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import lcg
from tidemark.functions import text as fn
from tidemark.operators import joins, score, text
from tidemark.session import scratch
from tidemark.sources import files

DOCS = [
    (1, "The quick  brown fox, it's QUICK/quick!"),
    (2, "don't stop the music — stop"),
    (3, None),
    (4, ""),
    (5, "one-two THREE; three (four) ∞ café it's it's it's"),
    (6, "a,b,,c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc long, text string").cache()


def words(t):
    return t.split()


def test_single_separators_keep_empty_pieces(docs):
    for sep in (" ", ","):
        want = Counter(w for _, t in DOCS if t is not None for w in t.split(sep))
        got = {r.word: r.n for r in text.word_count(docs, "text", sep).collect()}
        assert got == want and "" in got


def test_vocabulary_is_white_space_split(docs):
    want = Counter(w for _, t in DOCS if t for w in t.split())
    assert {r.word: r.n for r in text.vocabulary(docs, "text").collect()} == want


def test_stop_words(docs):
    got = {r.doc: r.tokens for r in text.tokenize(docs, "text").collect()}
    for doc, t in DOCS:
        if t is not None:
            assert got[doc] == [w for w in t.lower().split() if w not in fn.STOP_WORDS]


def test_words_and_punctuation(docs):
    got = docs.select("doc", fn.words_and_punctuation(F.col("text")).alias("k")).collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: r.doc), DOCS):
        assert r.k == (None if t is None else re.findall(r"\w+|[^\w\s]+", t))


def test_clean_text(docs):
    got = {r.doc: r.text for r in text.clean_text(docs, "text").collect()}
    for doc, t in DOCS:
        if t is not None:
            for mark in fn.SPACED:
                t = t.replace(mark, " ")
            for mark in fn.REMOVED:
                t = t.replace(mark, "")
            assert got[doc] == t


def test_ngrams_stay_in_documents(docs):
    rows = text.tokenize(docs, "text", stop=None)
    want = Counter(
        " ".join(g) for _, t in DOCS if t
        for k in [t.lower().split()] for g in zip(k, k[1:], k[2:])
    )
    assert {r.word: r.n for r in text.ngram_count(rows, "tokens", 3).collect()} == want


def test_top_with_percent(spark):
    rows = [("x", w, n) for w, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1))] + [("y", "z", 2)]
    counts = spark.createDataFrame(rows, "label string, word string, n long")
    got = {(r.label, r.word): r.percent for r in
           text.top_with_percent(counts, 2, ["label"]).collect()}
    assert got == {("x", "a"): 62.5, ("x", "b"): 37.5, ("y", "z"): 100.0}
    whole = text.top_with_percent(counts.drop("label"), 2).collect()
    assert [r.word for r in whole] == ["a", "b"]


def test_hot_group_is_limited_before_the_shuffle(spark):
    counts = spark.range(100).select(
        (F.col("id") % 1).alias("label"), F.col("id").cast("string").alias("word"), F.col("id").alias("n")
    )
    plan = text.top_with_percent(counts, 2, ["label"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and ", Partial" in plan


def test_sequences_and_padding(docs):
    def separated(t):
        table = str.maketrans({c: " " for c in fn.SEPARATORS})
        return [w for w in t.lower().translate(table).split(" ") if w]

    counts = Counter(w for _, t in DOCS if t for w in separated(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))[:7]
    ids = {w: i for i, w in enumerate(ranked, 1)}
    index = text.word_index(docs, "text", 8)
    assert {r.word: r.id for r in index.collect()} == ids
    rows = text.to_sequences(docs, index, "doc", "text")
    got = {r.doc: r.ids for r in rows.collect()}
    padded = {r.doc: r.ids for r in text.pad(rows, "ids", 4).collect()}
    assert set(got) == {d for d, _ in DOCS}
    for doc, t in DOCS:
        want = [ids[w] for w in separated(t or "") if w in ids]
        assert got[doc] == want
        assert padded[doc] == ([0] * 4 + want)[-4:]


def test_prepare(docs):
    out = text.prepare(docs, "doc", "text", num_words=20, length=6, share=0.3)
    rows = out.collect()
    assert {r.doc for r in rows} == {d for d, _ in DOCS}
    assert all(len(r.ids) == 6 for r in rows)
    assert {r.split for r in rows} <= {"train", "test"}


def test_coverage(spark):
    vocab = spark.createDataFrame([("a", 6), ("B", 3), ("c", 1), ("D", 2)], "word string, n long")
    vectors = spark.createDataFrame(
        [("a", [1.0]), ("B", [2.0]), ("c", [3.0]), ("C", [4.0]), ("b2", [5.0])],
        "word string, vector array<float>",
    )
    row = joins.coverage(vocab, vectors).first()
    assert (row.known_words, row.unknown_words) == (3, 1)
    assert (row.percent_of_vocab, round(row.percent_of_text, 6)) == (75.0, 83.333333)
    assert [r.word for r in joins.unknown_words(vocab, vectors).collect()] == ["D"]
    more = {r.word: r.vector for r in joins.add_lower_case(vectors, vocab).collect()}
    assert more.pop("b") == [2.0]
    assert more == {"a": [1.0], "B": [2.0], "c": [3.0], "C": [4.0], "b2": [5.0]}


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_nearest_neighbours_is_brute_force(spark, block_rows):
    numbers = np.array(lcg(40 * 3, 6)).reshape(40, 3)
    numbers[7] = numbers[8]  # equal distances: the smaller id wins
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(numbers)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    test, train = df.filter("id % 3 = 0"), df.filter("id % 3 <> 0")
    found = joins.nearest_neighbours(test, train, "id", "v", "label", 5, block_rows)
    got = {}
    for r in found.orderBy("test_id", "rank").collect():
        got.setdefault(r.test_id, []).append((round(r.distance2, 9), r.train_id))
    ids = [i for i in range(40) if i % 3]
    for i in range(0, 40, 3):
        want = sorted((round(float(((numbers[i] - numbers[j]) ** 2).sum()), 9), j) for j in ids)[:5]
        assert got[i] == want
    assert joins.vote(found).count() == 14


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_nearest_neighbours_leaves_the_row_itself_out(spark, block_rows):
    numbers = np.array(lcg(20 * 3, 6)).reshape(20, 3)
    numbers[7] = numbers[8]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(numbers)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    found = joins.nearest_neighbours(df, df, "id", "v", "label", 4, block_rows, leave_one_out=True)
    got = {}
    for r in found.orderBy("test_id", "rank").collect():
        got.setdefault(r.test_id, []).append(r.train_id)
    for i in range(20):
        far = [(round(float(((numbers[i] - numbers[j]) ** 2).sum()), 9), j) for j in range(20)]
        assert got[i] == [j for _, j in sorted(p for p in far if p[1] != i)[:4]]


def test_csv_keeps_any_text(spark):
    texts = ['a "b", c', "one\ntwo\r\nthree\rfour", " blanks ", "", None, '\\"', '"', "\t", ",", "\n", "#x"]
    path = scratch(spark, "csv_texts")
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").coalesce(2)
    files.write_csv(df, path)
    back = files.read_csv(spark, path, df.schema)
    assert {r.id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_vote_prefers_the_smaller_label(spark):
    rows = [(1, 5), (1, 2), (1, 5), (1, 2), (2, 9)]
    df = spark.createDataFrame(rows, "test_id long, train_label long")
    assert {r.test_id: r.predicted for r in joins.vote(df).collect()} == {1: 2, 2: 9}


def test_scores(spark):
    rows = [(1.0, 2.0), (0.0, 0.5), (4.0, 3.0), (5.0, None)]
    df = spark.createDataFrame(rows, "y double, p double")
    s = score.regression_scores(df, "y", "p").first()
    y, p = np.array([1.0, 0.0, 4.0]), np.array([2.0, 0.5, 3.0])
    assert (s.rows, s.zero_actuals) == (3, 1)
    assert np.isclose(s.mae, np.abs(y - p).mean())
    assert np.isclose(s.rmse, np.sqrt(((y - p) ** 2).mean()))
    assert np.isclose(s.mape, np.mean([1.0, 0.25]) * 100)
    assert np.isclose(s.r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert score.regression_scores(df, "y", "p", digits=3).first().mae == 0.833


def test_best_threshold_is_the_first_maximum(spark):
    rows = [(1, 0.9), (1, 0.3), (0, 0.25), (0, 0.12), (1, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")

    def f1(t):
        tp = sum(y == 1 and p > t for y, p in rows)
        fp = sum(y == 0 and p > t for y, p in rows)
        fn_ = sum(y == 1 and p <= t for y, p in rows)
        return 2 * tp / (2 * tp + fp + fn_) if tp else 0.0

    sweep = {r.threshold: r.f1 for r in score.f1_by_threshold(df, "y", "p").collect()}
    assert sweep == {t: f1(t) for t in score.F1_THRESHOLDS}
    best = score.best_f1_threshold(df, "y", "p").first()
    want = max(score.F1_THRESHOLDS, key=lambda t: (f1(t), -t))
    assert (best.threshold, best.f1) == (want, f1(want))


def test_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]
    df = spark.createDataFrame(rows, "y int, p int")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in
           score.classification_report(df, "y", "p").collect()}
    assert got[0] == (0.5, 0.5, 0.5, 2)
    assert got[1] == (2 / 3, 1.0, 0.8, 2)
    assert got[2] == (0.0, 0.0, 0.0, 1)
    assert score.accuracy(df, "y", "p").first().accuracy == 0.6


def test_sequences_of_a_large_index_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b A a, c"), (2, None), (3, ""), (1, "c c b z"), (4, "É é b")], "doc long, text string")
    index = text.word_index(docs, "text", 5)

    def got():
        return sorted((r.doc, r.ids) for r in text.to_sequences(docs, index, "doc", "text").collect())

    sent = got()
    assert len(sent) == 5 and [ids for doc, ids in sent if doc in (2, 3)] == [[], []]
    plan = text.to_sequences(docs, index, "doc", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(text, "DICTIONARY_BYTES", 10)
    assert got() == sent


def test_ngrams_of_short_and_missing_token_lists(spark):
    rows = [(1, ["a", "b", "c", "d"]), (1, ["a", "b"]), (2, []), (2, None), (2, ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    got = {(r.k, r.word): r.n for r in text.ngram_count(df, "tokens", 3, ["k"]).collect()}
    assert got == {(1, "a b c"): 1, (1, "b c d"): 1, (2, "a b c"): 1}
    assert {r.word: r.n for r in text.ngram_count(df, "tokens", 1).collect()} == {"a": 3, "b": 3, "c": 2, "d": 1}

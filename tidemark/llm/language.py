"""Language identification by the nearest of several centroids per language.

A text becomes the L2-normalised TF-IDF vector of its hashed letter trigrams (bytes; A-Z folded, other
ASCII is one blank). Each language has several centroids from spherical k-means. The prediction is the
language of the centroid with the largest cosine. A text is *rejected* when its cosine distance to the
nearest centroid is beyond the reach learned for that language: twice as far inside as the farthest
training text (cosine below half of the smallest training cosine).

The classifier, with its document frequencies, is fitted on at most ``rows_per_lang`` training rows per
language (smallest hashes of the id) and at most ``MOST_LANGS`` languages (most frequent first); both
bounds are parameters. Prediction covers every whole text, long ones in windows.

Null text, or text without a letter: ``und``, score 0, rejected. No training rows: every text is
``und``. A null id counts as held in. Ties between centroids go to the first language by name.
Repeated rows get one result each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

DIMENSIONS = 4096
ROWS_PER_LANG = 400
CLUSTERS = 4
MOST_LANGS = 200
WINDOW = 1 << 20  # bytes counted at once
DOCS_AT_ONCE = 256
REACH = 0.5

_FOLD = np.full(256, 0, np.uint32)
_FOLD[0x80:] = np.arange(27, 155)
for _i in range(26):
    _FOLD[0x41 + _i] = _FOLD[0x61 + _i] = 1 + _i


def _count(data: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Trigram counts of concatenated texts; ``owner`` is the text of each byte."""
    if len(data) < 3:
        return np.zeros((docs, DIMENSIONS), np.float32)
    c = _FOLD[data]
    gram = (c[:-2] * np.uint32(155) + c[1:-1]) * np.uint32(155) + c[2:]
    blanks = (c[:-1] == 0) & (c[1:] == 0)
    good = (owner[:-2] == owner[2:]) & ~(blanks[:-1] | blanks[1:])
    cell = (gram * np.uint32(2654435761)) >> np.uint32(20)
    at = owner[:-2][good].astype(np.int64) * DIMENSIONS + cell[good]
    return np.bincount(at, minlength=docs * DIMENSIONS).reshape(docs, DIMENSIONS).astype(np.float32)


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """One row of counts per text; memory is bounded by WINDOW, not by the length of a text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    start = 0
    while start < len(texts):
        end, total = start, 0
        while end < len(texts) and (end == start or total + len(texts[end]) <= WINDOW):
            total += len(texts[end])
            end += 1
        if end == start + 1 and total > WINDOW:
            for at in range(0, total, WINDOW):
                piece = np.frombuffer(texts[start][at : at + WINDOW + 2], np.uint8)
                out[start] += _count(piece, np.zeros(len(piece), np.int32), 1)[0]
        else:
            sizes = [len(t) for t in texts[start:end]]
            data = np.frombuffer(b"".join(texts[start:end]), np.uint8)
            out[start:end] = _count(data, np.repeat(np.arange(end - start, dtype=np.int32), sizes), end - start)
        start = end
    return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # clusters x dimensions, unit length
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # least cosine that a language accepts

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm == 0, 1, norm)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        return self.owner[best], np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each start is the vector farthest from those chosen before."""
    centres = x.mean(axis=0, keepdims=True)
    chosen = [int((x @ centres[0]).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(near.argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) for i in range(len(centres))])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), centres)
    return centres


def fit_counts(counts: np.ndarray, labels: list[str], clusters: int = CLUSTERS) -> Model:
    langs = sorted(set(labels))
    at = np.array([langs.index(v) for v in labels], np.int64)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = Model(langs, idf, np.zeros((0, DIMENSIONS)), at, at).vectors(counts)
    parts = [_clusters(x[at == i], clusters) for i in range(len(langs))]
    centroids = np.concatenate(parts).astype(np.float32)
    owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
    own = np.array([(x[at == i] @ parts[i].T).max(axis=1).min() for i in range(len(langs))])
    return Model(langs, idf, centroids, owner, own * REACH)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [b" " + (t or b"") + b" " for t in texts.cast(pa.binary()).to_pylist()]  # words end at blanks


def fit(train: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG, most_langs: int = MOST_LANGS, clusters: int = CLUSTERS) -> Model | None:
    """Fit on a bounded sample of the rows with text and language; None if there are none."""
    rows = train.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    slim = rows.select("lang", F.xxhash64("id").alias("order"))
    top = slim.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select("lang")
    chosen = Window.partitionBy("lang").orderBy("order")
    reach = (
        slim.withColumn("n", F.row_number().over(chosen))
        .filter(F.col("n") <= rows_per_lang)
        .groupBy("lang")
        .agg(F.max("order").alias("reach"))
        .join(top, "lang", "left_semi")
        .limit(most_langs)
    )
    # ties of the hash (repeated ids) could pass the bound, hence the second limit
    sample = (
        rows.withColumn("order", F.xxhash64("id"))
        .join(F.broadcast(reach), "lang")
        .filter(F.col("order") <= F.col("reach"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text")))
        .filter(F.col("n") <= rows_per_lang)
        .select("lang", "order", "text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                counts = np.minimum(trigram_counts(_bytes(b.column(2))), 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([r.tobytes() for r in counts], pa.binary())],
                    ["lang", "order", "counts"],
                )

    got = sample.mapInArrow(count, "lang string, order long, counts binary").toArrow().sort_by([("lang", "ascending"), ("order", "ascending"), ("counts", "ascending")])
    if not got.num_rows:
        return None
    counts = np.stack([np.frombuffer(c, np.uint16) for c in got["counts"].to_pylist()]).astype(np.float32)
    return fit_counts(counts, got["lang"].to_pylist(), clusters)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(df: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred, score and rejected for every row."""
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    if clash := {f.name for f in new} & set(keep):
        raise ValueError(f"kept columns are named like outputs: {sorted(clash)}")
    slim = df.select(*keep, F.col(text).alias("__source"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                source = b.column(b.num_columns - 1)
                written = np.array([has_letter(t) for t in source.to_pylist()], bool)
                pred = np.full(len(written), "und", object)
                score, rejected = np.zeros(len(written)), np.ones(len(written), bool)
                if model is not None and written.any():
                    lang, cos = model.nearest(trigram_counts(_bytes(source)))
                    pred[written] = np.array(model.langs, object)[lang[written]]
                    score[written] = cos[written]
                    rejected[written] = cos[written] < model.least[lang[written]]
                made = [pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*keep, *(f.name for f in new)])

    kept = [f for f in slim.schema.fields if f.name != "__source"]
    return slim.mapInArrow(work, StructType([*kept, *new]))


def held_out(id: str = "doc_id"):
    """True for the quarter of ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(df: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows that are not held out."""
    model = fit(df.filter(~held_out()), **bounds)
    marked = df.select("doc_id", held_out().alias("held_out"), "text")
    return identify(marked, model, ["doc_id", "held_out"])

"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import chunks, pack_columns, small_batches

#: Bound on the labelled rows that the model is fitted on and votes with (the rows of smallest id hash).
MAX_LABELLED = 6144
#: Hashed byte trigrams, four-grams of character classes, and scalars.
TRIGRAMS, SHAPES, SCALARS = 2048, 1296, 8
DIMENSIONS = 48
NEIGHBOURS = 40
#: A neighbour's vote weighs its cosine to this power; the prior votes with the weight PRIOR.
POWER, PRIOR = 4, 2.0
PRIOR_SCORE = 0.9
THRESHOLD = 0.7
#: Documents whose cosines with all labelled vectors are held at a time.
BLOCK = 256
#: Bytes of one text that are counted at a time.
SEGMENT = 1 << 18

_CLASSES = np.array([0 if 97 <= c <= 122 or c >= 128 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c == 32 else 4 if c == 10 else 5 for c in range(256)], dtype=np.int64)


def features(text: bytes) -> np.ndarray:
    """Counts over the whole text: square roots of shares of trigrams and of class four-grams, repetition, and length."""
    data = text + b" " * (4 - len(text))
    grams, shapes = np.zeros(TRIGRAMS, dtype=np.int64), np.zeros(SHAPES, dtype=np.int64)
    for at in range(0, len(data) - 3, SEGMENT):
        b = np.frombuffer(data[at : at + SEGMENT + 3], dtype=np.uint8).astype(np.int64)
        h = (b[:-3] * 65599 + b[1:-2]) * 65599 + b[2:-1]
        h = (h ^ (h >> 15)) * 0x2545F491
        grams += np.bincount((h >> 7) % TRIGRAMS, minlength=TRIGRAMS)
        c = _CLASSES[b]
        shapes += np.bincount(((c[:-3] * 6 + c[1:-2]) * 6 + c[2:-1]) * 6 + c[3:], minlength=SHAPES)
    words = text.split()
    n = len(words)
    repeated = sum(a == b for a, b in zip(words, words[1:])) / max(n - 1, 1)
    known = [1 - len(set(part)) / len(part) for part in (words[at : at + 400] for at in range(0, n, 400))]
    scalars = np.zeros(SCALARS)
    scalars[0] = 1.5 * repeated**0.5
    scalars[1] = max(0.0, (sum(known) / len(known) if known else 0.0) - (0.2 if n < 400 else 0.45))
    scalars[2 + min(5, int(np.log2(n + 1) / 1.5))] = 0.15
    return np.concatenate([0.7 * np.sqrt(grams / grams.sum()), 0.7 * np.sqrt(shapes / shapes.sum()), scalars]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Projection to the latent space, and the labelled vectors in it with their labels."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray) -> Model:
        """Fits on float32 rows, which are centred in place."""
        mean = rows.mean(axis=0) if len(rows) else np.zeros(TRIGRAMS + SHAPES + SCALARS, dtype=np.float32)
        centred = rows
        centred -= mean
        # a randomised range finder: a few power steps on a narrow block, so the fit stays small in memory
        block = np.random.default_rng(0).standard_normal((centred.shape[1], DIMENSIONS + 16)).astype(np.float32)
        for _ in range(4):
            block = np.linalg.qr(centred.T @ (centred @ block))[0] if len(rows) else block
        if len(rows):
            _, _, turn = np.linalg.svd(centred @ block, full_matrices=False)
            block = block @ turn.T
        axes = block[:, :DIMENSIONS].astype(np.float32)
        return cls(mean, axes, _unit(centred @ axes), labels.astype(np.float32))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Weighted votes of the nearest labelled vectors by exact cosine, block by block.

        Every block has the same shape, the last one with empty rows, so that a row's products don't depend on what
        stands beside it and equal rows score alike. Of vectors equally near at the last place, those count that
        the partition of the row's cosines puts first, which are the same ones for equal rows.
        """
        out = np.empty(-(-len(rows) // BLOCK) * BLOCK)
        for at in range(0, len(rows), BLOCK):
            block = np.zeros((BLOCK, rows.shape[1]), dtype=np.float32)
            block[: len(rows) - at] = rows[at : at + BLOCK]
            own = _unit((block - self.mean) @ self.axes)
            cosines = own @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            if k:
                top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cosines, top, axis=1), 0).astype(np.float64) ** POWER
                out[at : at + BLOCK] = ((weight * self.labels[top]).sum(axis=1) + PRIOR * PRIOR_SCORE) / (weight.sum(axis=1) + PRIOR)
            else:
                out[at : at + BLOCK] = PRIOR_SCORE
        return out[: len(rows)]


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def held_out(id_col: str | Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 modulo 4; a null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most MAX_LABELLED labelled documents that are not held out, whatever their labels, so that both keep their shares at any size.

    Ids with several rows take the first by label and text; rows with a null label or id are not used.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    rows = rows.groupBy("__id").agg(F.max("__label").alias("__label"))
    order = [F.xxhash64(F.col("__id").cast("string")), F.col("__id")]
    chosen = rows.orderBy(*order).limit(MAX_LABELLED)
    source = small_batches(docs).select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    source = source.join(F.broadcast(chosen), "__id").select("__id", "__label", "__text")  # at most MAX_LABELLED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            made = [features(t).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(made, pa.binary())], names=["__id", "__label", "__vector"])

    made = source.mapInArrow(run, f"__id {source.schema[0].dataType.simpleString()}, __label int, __vector binary")
    # repeated ids keep one row, so at most MAX_LABELLED rows come
    made = made.groupBy("__id").agg(F.max(F.struct("__label", "__vector")).alias("v")).select("__id", "v.*")
    found = made.collect()
    found.sort(key=lambda r: repr(r[0]))
    labels_, matrix = np.array([r[1] for r in found]), np.empty((len(found), TRIGRAMS + SHAPES + SCALARS), dtype=np.float32)
    for i, (_, _, vector) in enumerate(found):
        matrix[i] = np.frombuffer(vector, dtype=np.float16)
    del found
    return Model.fit(matrix, labels_)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds `out`, a double from 0 to 1, to every document.

    Only the text counts. Null or empty text is scored like any other, from its (empty) features; equal
    texts score alike; with no labelled rows every score is the prior. Other columns pass through.
    """
    docs, unpack = pack_columns(small_batches(docs), text_col)
    names = docs.columns
    source = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"), F.lit(0.0).cast("double").alias("__score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            texts = batch.column(len(names)).to_pylist()
            scores = np.concatenate([shared.value.score(np.array([features(t) for t in texts[at : at + BLOCK]])) for at in range(0, len(texts), BLOCK)])
            columns = [batch.column(i) for i in range(len(names) + 1)] + [pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__text", "__score"])

    return unpack(source.mapInArrow(run, source.schema).drop("__text").withColumnRenamed("__score", out))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the labels that are not held out and scores all documents."""
    return score_documents(docs, fit(docs, labels, id_col, text_col), text_col)


def op5_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))

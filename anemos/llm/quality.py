"""Quality classifier by nearest-neighbour voting among latent-semantic vectors (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anemos.llm._common import LOWER, SpanHash, free_name, text_slices, word_spans

#: Terms: hashed words, hashed 4-grams of character classes, and binned shares of repeated words.
WORD_TERMS, SHAPE_TERMS, REPEAT_TERMS = 2048, 2048, 64
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS

# Class of each byte: 0 other control, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 full stop, 7 comma, 8 other end of
# sentence, 9 bar or bracket, 10 other punctuation, 11 byte of a longer character.
CLASS = np.zeros(256, np.uint16)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 11
CLASS[[33, *range(34, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 10
CLASS[[32, 9]], CLASS[[10, 13]], CLASS[46], CLASS[44], CLASS[[33, 63, 58, 59]], CLASS[[124, 91, 93, 60, 62, 123, 125]] = 4, 5, 6, 7, 8, 9


def term_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Term counts (texts x TERMS) of a slice of whole texts."""
    n = len(offs) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(buf):
        return out
    doc = np.repeat(np.arange(n), np.diff(offs))
    code = CLASS[buf]
    gram = code.astype(np.uint64)
    for k in range(1, 4):
        gram[:-k] |= code[k:].astype(np.uint64) << np.uint64(4 * k)
    shape = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
    out[:, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount(doc * SHAPE_TERMS + shape, minlength=n * SHAPE_TERMS).reshape(n, SHAPE_TERMS)
    start, end, of = word_spans(buf, offs)
    if len(start):
        h = SpanHash(LOWER[buf])(start, end)
        out[:, :WORD_TERMS] = np.bincount(of * WORD_TERMS + (h >> np.uint64(53)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
        words = np.bincount(of, minlength=n)
        for lag in (1, 2, 3, 4):
            same = (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
            share = np.bincount(of[lag:][same], minlength=n) / np.maximum(words, 1)
            bin_ = np.minimum((share * 16).astype(int), 15)
            out[np.arange(n), WORD_TERMS + SHAPE_TERMS + 16 * (lag - 1) + bin_] = np.where(bin_ > 0, 50 * share, 0)
    return out


@dataclass
class QualityModel:
    """Everything scoring needs. vectors: unit rows, at most the documented bound of them; vote: a row's label; weight: how
    many labelled rows it stands for."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    vote: np.ndarray
    weight: np.ndarray
    prior: float
    neighbours: int

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return self.on_axes(np.log1p(counts) * self.idf)

    def on_axes(self, weighted: np.ndarray) -> np.ndarray:
        """Unit vectors of weighted counts."""
        x = weighted @ self.axes
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)

    def score(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        """Share of similarity-weighted votes for label 1 among the nearest labelled vectors; the prior where nothing is
        similar (an empty text)."""
        out = np.full(len(counts), self.prior)
        if not len(self.vectors):
            return out
        for lo in range(0, len(counts), block):
            sim = self.embed(counts[lo : lo + block]) @ self.vectors.T
            k = min(self.neighbours, sim.shape[1])
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, near, 1).astype(float), 0) ** 8 * self.weight[near]
            total = w.sum(1)
            ok = total > 1e-9
            out[lo : lo + block][ok] = ((w * self.vote[near]).sum(1)[ok] / total[ok]).clip(0, 1)
        return out


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, value = [], []
        for _, _, buf, offs in text_slices(batch.column(1)):
            counts = term_counts(buf, offs)
            for row in counts:
                i = np.flatnonzero(row)
                at.append(i.astype(np.int32))
                value.append(row[i])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["label", "at", "value"])


def _dense(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(labels, counts x TERMS) of what _sparse made, a chunk at a time and without Python values, which would take some times the matrix."""
    x, row = np.zeros((got.num_rows, TERMS), np.float32), 0
    for batch in got.to_batches():
        n = batch["at"].value_lengths().to_numpy(zero_copy_only=False)
        x[row + np.repeat(np.arange(len(n)), n), batch["at"].flatten().to_numpy()] = batch["value"].flatten().to_numpy()
        row += len(n)
    return got["label"].to_numpy().astype(float), x


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 2000, size: int = 48, neighbours: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most `per_label` labelled documents of each label (0 and 1), those whose ids hash lowest; each stands for
    its share of its label, so that votes keep the labels' true proportions. The bound keeps the driver's matrix and what is
    broadcast under 2 x per_label rows. Labels that are null or without a document teach nothing; if an id has several
    labels the largest counts."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5, neighbours)
    picked = None
    for label in sorted(share):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(per_label)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).groupBy(id_col).agg(F.max("label").alias("label"), F.max(text_col).alias("text")).orderBy(id_col)
    got = rows.select("label", "text").mapInArrow(_sparse, "label int, at array<int>, value array<float>").toArrow()
    y, z = _dense(got)
    del got
    idf = (np.log((1 + len(z)) / (1 + np.count_nonzero(z, axis=0))) + 0.1).astype(np.float32)
    np.log1p(z, out=z)  # in place: the matrix, of some 66 MB at its bound, is held once
    z *= idf
    basis = z.T @ (z @ np.random.default_rng(1).standard_normal((TERMS, min(size + 16, max(1, len(z))))).astype(np.float32))
    for _ in range(3):
        basis = z.T @ (z @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    _, _, turn = np.linalg.svd(z @ basis, full_matrices=False)
    axes = (basis @ turn.T[:, :size]).astype(np.float32)
    counted = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([share.get(k, 0) / max(1, counted[k]) for k in (0, 1)])[y.astype(int)] if len(y) else np.zeros(0)
    model = QualityModel(idf, axes, np.zeros((0, size), np.float32), y, weight, share.get(1, 0) / sum(share.values()), neighbours)
    model.vectors = model.on_axes(z) if len(z) else np.zeros((0, axes.shape[1]), np.float32)
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns and rows of docs plus a score from 0 to 1 (higher: label 1 likelier) of the whole text. Null and empty
    texts get the share of label 1. An existing column of that name is replaced."""
    docs = docs.drop(score_col) if score_col in docs.columns else docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [held.value.score(term_counts(buf, offs)) for _, _, buf, offs in text_slices(batch.column(where))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *score]))], names=schema.names)

    return docs.mapInArrow(per_batch, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns only. With no usable label all stay."""
    score = free_name(docs.columns, "quality_score")
    scored = score_quality(docs, fit_quality(docs, labels, **fit), score_col=score)
    return scored.where(F.col(score) >= threshold).drop(score)

"""Quality classifier: Naive Bayes support vectors (NBSVM).

Features are indicators of n-grams of the whole text: one and two consecutive
lower-cased words, and one and two consecutive word shapes (letter case, digits
and punctuation of a word, runs squeezed), hashed to ``BUCKETS``. Each indicator
is scaled by the log ratio of its smoothed class frequencies; a linear model with
hinge loss is fitted to the scaled indicators by dual coordinate descent, and its
margin is turned into a probability by logistic calibration on held-back folds.

The fit uses at most ``MAX_TRAIN`` labelled rows (those with the least hash of
their id and, of texts with the same id, that with the least hash, so neither the
choice nor the bound depends on partitioning or repeated rows); scoring covers every
row and every word. The model is two arrays of ``BUCKETS`` floats, the only thing
sent to the workers.

Defined results: null texts score as empty ones; an empty text has only the bias;
null labels and labels of a null id are skipped; a repeated (id, label) counts once and contradicting
labels of one id both count; without labels of both classes every score is the
share of label 1 (0.5 without labels); repeated documents get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import LOWER, NOT_SPACE, Prefix, U, mix, pieces, row_of, word_spans
from .scratch import Scratch, prepare_python

BUCKETS = 1 << 18
MAX_TRAIN = 6000
FOLDS, EPOCHS, C, ALPHA = 3, 12, 1.0, 0.5
THRESHOLD = 0.3

#: Shape class of a byte: lower, upper, digit, non-ASCII letter byte, and each punctuation mark as itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text: (sorted buckets, offsets by text)."""
    starts, ends, words = word_spans(data, offs, NOT_SPACE)
    rows = row_of(words)
    lowered = Prefix(LOWER[data]).spans(starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(data.size, bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True  # a run is squeezed within its word
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = Prefix(shape[keep]).spans(at[starts], at[ends])
    parts, owners = [], []
    for salt, h in ((1, lowered), (2, shapes)):
        parts.append(h + U(salt))
        owners.append(rows)
        same = rows[1:] == rows[:-1]
        parts.append((h[:-1] * U(0xD6E8FEB86659FD93) + h[1:] + U(salt * 7919))[same])
        owners.append(rows[1:][same])
    bucket = (mix(np.concatenate(parts)) >> U(64 - 18)).astype(np.int64)
    key = np.unique(np.concatenate(owners) * BUCKETS + bucket)
    return (key & (BUCKETS - 1)).astype(np.int32), np.searchsorted(key, np.arange(len(offs)) * BUCKETS)


def _ratios(x: np.ndarray, offs: np.ndarray, y: np.ndarray) -> np.ndarray:
    own = np.repeat(y, np.diff(offs))
    p = ALPHA + np.bincount(x[own > 0], minlength=BUCKETS).astype(float)
    q = ALPHA + np.bincount(x[own <= 0], minlength=BUCKETS).astype(float)
    return np.log((p / (ALPHA + (y > 0).sum())) / (q / (ALPHA + (y <= 0).sum())))


def _descend(x: np.ndarray, offs: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows are scaled to unit length."""
    rng = np.random.default_rng(7)
    n = y.size
    v = r[x]
    norm = np.sqrt(np.maximum(np.add.reduceat(np.append(v * v, 0.0), offs[:-1]) * (np.diff(offs) > 0), 1e-12))
    v = v / np.repeat(norm, np.diff(offs))
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(n)
    rows = [(x[offs[i] : offs[i + 1]], v[offs[i] : offs[i + 1]]) for i in range(n)]
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(n):
            xi, vi = rows[i]
            g = y[i] * (w[xi] @ vi + bias) - 1.0
            new = min(max(alpha[i] - g / (1.0 + 1e-9 + (xi.size > 0)), 0.0), C)
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[xi] += d * vi
                bias += d
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, bias


def _margins(x: np.ndarray, offs: np.ndarray, r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    v, n = r[x], len(offs) - 1
    own = np.repeat(np.arange(n), np.diff(offs))
    norm = np.sqrt(np.maximum(np.bincount(own, v * v, n), 1e-12))
    return np.bincount(own, v * w[x], n) / norm + bias


def _logistic(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(label 1 | margin), by Newton steps with smoothed targets."""
    pos, neg = t.sum(), (1 - t).sum()
    target = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
        hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(x: np.ndarray, offs: np.ndarray, labels: np.ndarray) -> dict:
    """Model of features (as ``features`` gives them) and 0/1 labels."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = float(np.mean(labels)) if labels.size else 0.5
    if labels.size < 2 * FOLDS or labels.min() == labels.max():
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return {"w": np.zeros(BUCKETS, np.float32), "r": np.zeros(BUCKETS, np.float32), "bias": 0.0, "a": 0.0, "b": float(odds)}

    def part(rows):
        lengths = np.diff(offs)[rows]
        return np.concatenate([x[offs[i] : offs[i + 1]] for i in rows]), np.concatenate([[0], np.cumsum(lengths)]), y[rows]

    fold, margin = np.arange(y.size) % FOLDS, np.zeros(y.size)
    for k in range(FOLDS):
        tx, to, ty = part(np.flatnonzero(fold != k))
        if ty.min() == ty.max():
            continue
        r = _ratios(tx, to, ty)
        hx, ho, _ = part(own := np.flatnonzero(fold == k))
        margin[own] = _margins(hx, ho, r, *_descend(tx, to, ty, r))
    a, b = _logistic(margin, labels.astype(float))
    r = _ratios(x, offs, y)
    w, bias = _descend(x, offs, y, r)
    return {"w": w.astype(np.float32), "r": r.astype(np.float32), "bias": float(bias), "a": a, "b": b}


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offs in pieces(batch.column("text")):
            x, rows = features(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(x, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in ("doc_id", "label", "h")), lists], names=["doc_id", "label", "h", "x"])


def train(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_TRAIN) -> dict:
    """Fit on ``labelled`` (doc_id, label): at most ``max_rows`` of them."""
    prepare_python(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    chosen = labelled.dropna().distinct().withColumn("h", F.xxhash64("doc_id", "label")).orderBy("h", "doc_id", "label").limit(max_rows)
    chosen = scratch.save("chosen", chosen)  # at most max_rows rows: broadcast is bounded by that parameter
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text of each (id, label), so no more rows than were chosen: of repeated ids that with the least hash
    rows = rows.groupBy("h", "doc_id", "label").agg(F.min(F.struct(F.sha2("text", 256), "text")).alias("t")).select("doc_id", "label", "h", F.col("t.text").alias("text"))
    got = scratch.save("features", rows.mapInArrow(_featurize, "doc_id long, label int, h long, x array<int>")).orderBy("h", "doc_id", "label").toArrow()
    lists = got.column("x").combine_chunks()
    offs = np.asarray(lists.offsets, np.int64) if len(lists) else np.zeros(1, np.int64)
    x = np.asarray(lists.values, np.int64)[offs[0] : offs[-1]] if len(lists) else np.zeros(0, np.int64)
    return fit(x, offs - offs[0], got.column("label").to_numpy().astype(int))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    prepare_python(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at, to, data, offs in pieces(batch.column("text")):
                x, rows = features(data, offs)
                z = m["a"] * _margins(x, rows, m["r"], m["w"], m["bias"]) + m["b"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = train(docs, labels.filter(~held("doc_id")).select("doc_id", F.col("quality").cast("int").alias("label")))
    out = score(docs, model)
    return out.select("doc_id", held("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))

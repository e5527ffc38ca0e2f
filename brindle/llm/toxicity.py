"""Toxicity as severity grades by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w . x - theta_k): all thresholds share the weights w, and theta_1 < theta_2 < ... by
construction.  x says which words a text holds (A-Z lower-cased runs of letters and digits, as 64-bit hashes).  The model is
fitted in numpy on at most ``max_rows`` labelled rows (a stated bound, drawn by a hash of the id; one row for each id); features
are the words whose share differs between grade 0 and the rest by ``least_z`` standard errors or more, however many, so what is broadcast follows that bound.  Scoring reads every text whole.

The driver's labels are two flags, so grades are: 0 not toxic, 1 toxic, 2 toxic and of low quality.

Defined results: a null or empty text has no words, so the bare thresholds' severity; without labelled rows of two grades
every severity is 0 and nothing is rejected; a null grade is no label; of several labels of one id the highest counts; of several
rows of a drawn id the one with the least text hash is fitted; repeated rows stay repeated and are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, text_batches
from ._words import ALNUM, U64, Words, slices


#: Most texts of grade 0 stay far below, so one telling word in a long text is enough.
REJECT_AT = 0.3


@dataclass(frozen=True)
class OrdinalModel:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one for each grade above 0

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each score (rows) and k (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, grades = b.column(0).to_pylist(), b.column(1)
        for lo, hi in slices(texts):
            w = Words(texts[lo:hi], ALNUM)
            rows = [np.unique(w.hash[a:z]).astype(np.int64) for a, z in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            yield pa.record_batch({"grade": grades.slice(lo, hi - lo), "words": pa.array(rows, pa.list_(pa.int64()))})


def parameters(params: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and thresholds that ascend by construction: the first, then what lies between them as soft-plus steps."""
    return params[:m], params[m] + np.concatenate(([0.0], np.cumsum(np.logaddexp(0, params[m + 1 :]))))


def loss_and_gradient(params: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray, m: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with shrinkage, and its gradient; ``row`` and ``col`` say which row holds which word."""
    n, k = len(grades), len(params) - m
    w, theta = parameters(params, m)
    s = np.bincount(row, weights=w[col], minlength=n)
    cum = np.column_stack((np.ones(n), _sigmoid(s[:, None] - theta[None, :]), np.zeros(n)))
    at = np.arange(n)
    like = np.maximum(cum[at, grades] - cum[at, grades + 1], 1e-12)
    slope = cum * (1 - cum)  # of each cumulative probability; none at either end
    up, down = slope[at, grades] / like, slope[at, grades + 1] / like
    g_w = -np.bincount(col, weights=(up - down)[row], minlength=m) / n + l2 * w
    g_theta = np.array([((grades == j) * up).sum() - ((grades == j - 1) * down).sum() for j in range(1, k + 1)]) / n
    tail = np.cumsum(g_theta[::-1])[::-1]
    return -np.log(like).mean() + l2 / 2 * (w @ w), np.concatenate((g_w, tail[:1], tail[1:] * _sigmoid(params[m + 1 :])))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, steps: int = 500, l2: float = 1e-5, least_z: float = 3.5) -> OrdinalModel:
    """Fit weights and ordered thresholds by full-batch Adam on the cumulative-link likelihood."""
    k = int(grades.max()) if len(grades) else 0
    n = len(grades)
    if k == 0 or not (grades == 0).any():
        return OrdinalModel(np.empty(0, U64), np.empty(0), np.full(max(k, 1), np.inf))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    words, col = np.unique(np.concatenate(rows).astype(U64), return_inverse=True)
    hit, df = np.bincount(col, weights=grades[row] > 0, minlength=len(words)), np.bincount(col, minlength=len(words))
    n1 = int((grades > 0).sum())
    p = (df + 1) / (n + 2)
    z = (hit / n1 - (df - hit) / (n - n1)) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)))
    words, used = words[np.abs(z) >= least_z], np.abs(z)[col] >= least_z
    row, col, m = row[used], (np.cumsum(np.abs(z) >= least_z) - 1)[col[used]], len(words)
    base = np.array([np.clip((grades >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, k + 1)])
    theta = np.log((1 - base) / base)
    params = np.concatenate((np.zeros(m), theta[:1], np.log(np.expm1(np.maximum(np.diff(theta), 1e-2)))))
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        _, grad = loss_and_gradient(params, row, col, grades, m, l2)
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        params = params - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    return OrdinalModel(words, *parameters(params, m))


def train(
    docs: DataFrame, grades: DataFrame, text_col: str = "text", id_col: str = "doc_id", grade_col: str = "grade",
    max_rows: int = 12_000,
) -> OrdinalModel:
    """Fit on at most ``max_rows`` rows of ``grades`` (id, grade from 0) and their texts in ``docs``."""
    labelled = pick(grades, id=id_col, grade=grade_col).where("id is not null and grade is not null")
    labelled = labelled.groupBy("id").agg(F.max("grade").cast("int").alias("grade"))
    drawn = labelled.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # its size is bounded: broadcast
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(drawn), "id")
    # One row for each id, however many there are: taken together before the shuffle.
    texts = texts.groupBy("id").agg(F.min_by(F.struct("text", "grade"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("r.text", "r.grade")
    rows = (
        texts.select(F.col("text").cast("binary").alias("text"), "grade")
        .mapInArrow(_features, "grade int, words array<long>")
        .toArrow()
    )
    words = [np.asarray(x.values, np.int64) if x.values is not None else np.empty(0, np.int64) for x in rows.column("words")]
    return fit_ordinal(words, np.asarray(rows.column("grade"), np.int64))


def _flags(model: OrdinalModel) -> np.ndarray:
    """Which upper hash bits the known words have: most other words are passed over by one look."""
    flags = np.zeros(1 << 20, bool)
    flags[(model.keys >> U64(44)).astype(np.int64)] = True
    return flags


def word_scores(w: Words, model: OrdinalModel, flags: np.ndarray) -> np.ndarray:
    """Sum of the weights of each document's distinct known words."""
    n = len(w.counts)
    at = np.flatnonzero(flags[(w.hash >> U64(44)).astype(np.int64)])
    if not len(at):
        return np.zeros(n)
    k = np.minimum(np.searchsorted(model.keys, w.hash[at]), len(model.keys) - 1)
    ok = model.keys[k] == w.hash[at]
    doc = np.searchsorted(w.bounds, at[ok], side="right") - 1
    pair = np.unique(doc * len(model.keys) + k[ok])
    return np.bincount(pair // len(model.keys), weights=model.weights[pair % len(model.keys)], minlength=n)


def _score(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    flags = _flags(model)
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in slices(texts):
            p = model.above(word_scores(Words(texts[lo:hi], ALNUM), model, flags))
            yield pa.record_batch(
                {
                    "id": ids.slice(lo, hi - lo),
                    "p_toxic": pa.array(np.round(p[:, 0], 9), pa.float64()),
                    "severity": pa.array(np.round(p.sum(axis=1), 9), pa.float64()),
                    "rejected": pa.array(p[:, 0] >= REJECT_AT, pa.bool_()),
                }
            )


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, P(grade >= 1), expected severity and whether the document is rejected (P(grade >= 1) of ``REJECT_AT`` or more)."""
    base = pick(docs, id=id_col, text=text_col)
    kind = dict(base.dtypes)["id"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    return (
        base.select("id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(lambda it: _score(it, held.value), f"id {kind}, p_toxic double, severity double, rejected boolean")
        .withColumnRenamed("id", id_col)
    )


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Severity grades of the labels table: 0, 1 (toxic), 2 (toxic and of low quality)."""
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    return labels.select(id_col, grade.alias("grade"))


def _keep_mild(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    flags = _flags(model)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        for lo, hi in slices(texts):
            p = model.above(word_scores(Words(texts[lo:hi], ALNUM), model, flags))
            yield batch.slice(lo, hi - lo).filter(pa.array(p[:, 0] < REJECT_AT))


def reject_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` (column ``text``) that are not rejected, with all their columns."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _keep_mild(it, held.value), docs.schema)

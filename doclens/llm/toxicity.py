"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams (4 to 6 bytes) is counted per class over a labelled sample of bounded size.
Every n-gram whose shares in the classes differ significantly, by likelihood ratio and at a false discovery rate, is a
feature, however many there are; the log-count ratios scale them, and a logistic regression is fitted to the scaled features. Scoring reads every whole text; a feature counts once per text, so length does not dilute it.

Defined results: null and empty texts get the score of the intercept; without labels of both classes every score is
the share of label 1 (0 without labels); repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import BLOCK_SCHEMA, block_rows, bound_batches, gather_blocks, lean, quoted, row_chunks, sum_blocks, text_buffer
from doclens.llm.grams import STREAM, flag, gram_cells, labels_of, sample_labelled

SIZES = (4, 5, 6)
BLOCK = 1 << 16
#: A feature is in so many documents at least; of all features, about this share differ between the classes by chance.
LEAST_DOCS, FALSE = 3, 0.05
#: Pairs of row and feature that are worked on at once.
STEP = 1 << 20


class Model:
    """lut: cell -> feature number + 1, 0 for none; weights of the features, already times the ratio; intercept."""

    def __init__(self, lut: np.ndarray, weights: np.ndarray, intercept: float, bits: int):
        self.lut, self.weights, self.intercept, self.bits = lut, weights, intercept, bits

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs, sorted."""
        stream, pairs = STREAM[data], []
        for n in SIZES:
            found = self.lut[gram_cells(stream, n, self.bits)]
            at = np.flatnonzero(found)
            rows = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[rows + 1]
            pairs.append(rows[inside] << 32 | found[at[inside]])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return both >> 32, (both & 0xFFFFFFFF) - 1

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, features = self.hits(data, offsets)
        margin = self.intercept + np.bincount(rows, self.weights[features], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(batch.column(column))
    for start, end in row_chunks(offsets):
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]


def class_counts(texts: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that have a cell, over (text, y) rows."""

    def run(batches):
        counts = np.zeros(2 << bits, np.int32)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for start, _, data, offsets in chunks(batch, 0):
                stream = STREAM[data]
                for row in range(len(offsets) - 1):
                    own = stream[offsets[row] : offsets[row + 1]]
                    cells = np.unique(np.concatenate([gram_cells(own, n, bits) for n in SIZES]))
                    counts[cells.astype(np.int64) + (int(y[start + row]) << bits)] += 1
        yield from block_rows(counts, BLOCK)

    summed = gather_blocks(sum_blocks(texts.select("text", "y").mapInArrow(lean(run), BLOCK_SCHEMA), np.int32), 2 << bits, BLOCK, np.int32)
    return summed[: 1 << bits].astype(float), summed[1 << bits :].astype(float)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, dims: int, penalty: float, steps: int = 100, memory: int = 10) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows by L-BFGS with step halving; the intercept is not penalised.

    rows, cols: the entries; those of a column have the value that `scale` has for it.
    """
    n, parts = len(y), [slice(k, k + STEP) for k in range(0, len(rows), STEP)]

    def loss(w):
        margin, own, grad = np.full(n, w[-1]), scale * w[:-1], np.zeros(dims)
        for s in parts:
            margin += np.bincount(rows[s], own[cols[s]], minlength=n)
        slope = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
        value = (np.logaddexp(0, margin) - y * margin).mean() + 0.5 * penalty * (w[:-1] ** 2).sum()
        for s in parts:
            grad += np.bincount(cols[s], slope[rows[s]], minlength=dims)
        grad = np.append(grad * scale / n + penalty * w[:-1], slope.mean())
        return value, grad

    w = np.zeros(dims + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = grad.copy(), []
        for s, d, rho in reversed(past):
            a = rho * (s @ q)
            used.append(a)
            q -= a * d
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0
        for (s, d, rho), a in zip(past, reversed(used), strict=True):
            q += (a - rho * (d @ q)) * s
        t, down = 1.0, grad @ q
        while True:
            new_value, new_grad = loss(w - t * q)
            if new_value <= value - 1e-4 * t * down or t < 1e-8:
                break
            t /= 2
        s, d = -t * q, new_grad - grad
        w, grad, gain, value = w + s, new_grad, value - new_value, new_value
        if s @ d > 1e-12:
            past = [*past, (s, d, 1 / (s @ d))][-memory:]
        if gain < 1e-7:
            break
    return w[:-1], float(w[-1])


def likelihood_ratio(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of shares p of n1 and q of n0 against one share for both."""
    share = (p + q) / (n1 + n0)
    term = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)
    return 2 * (term(p, n1 * share) + term(q, n0 * share) + term(n1 - p, n1 * (1 - share)) + term(n0 - q, n0 * (1 - share)))


def train(texts: DataFrame, bits: int, features: int, penalty: float) -> Model:
    """texts: (id, text, y), of bounded size."""
    spark = texts.sparkSession
    sizes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    empty = np.zeros(1 << bits, np.int32)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(empty, np.zeros(1), float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -500, 500)), bits)
    q, p = class_counts(texts, bits)
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    differ = -likelihood_ratio(p, q, n1, n0) / 2  # the log of a bound of the chance to differ as much by chance
    order = np.argsort(differ, kind="stable")
    tested = np.flatnonzero((p + q >= LEAST_DOCS)[order])
    # Benjamini and Hochberg: of the n-grams that are told apart, a share of FALSE is so by chance
    fine = np.flatnonzero(differ[order[tested]] <= np.log(FALSE * np.arange(1, len(tested) + 1) / max(len(tested), 1)))
    told = np.zeros(len(p), bool)
    told[order[tested[: int(fine.max(initial=-1)) + 1]]] = True
    told[order[:features]] = True
    picked = order[told[order] & ((p + q)[order] > 0)]
    lut = empty.copy()
    lut[picked] = np.arange(1, len(picked) + 1)
    draft = Model(lut, ratio[picked], 0.0, bits)
    shared = spark.sparkContext.broadcast(draft)

    def run(batches):
        model = shared.value
        for batch in batches:
            for start, end, data, offsets in chunks(batch, 0):
                rows, found = model.hits(data, offsets)
                cuts = np.searchsorted(rows, np.arange(1, end - start))
                own = [x.astype(np.int32).tobytes() for x in np.split(found, cuts)]
                yield pa.record_batch({"y": batch.column(1).slice(start, end - start), "hits": pa.array(own, pa.binary())})

    sample = texts.select("text", "y").mapInArrow(lean(run), "y int, hits binary").collect()
    found = [np.frombuffer(bytes(r["hits"]), np.int32) for r in sample]
    y = np.array([r["y"] for r in sample], float)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), [len(f) for f in found])
    cols = np.concatenate(found)
    del sample, found
    weights, intercept = fit_logistic(rows, cols, draft.weights, y, len(picked), penalty)
    return Model(lut, weights * draft.weights, intercept, bits)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, bits: int = 22, features: int = 1024, penalty: float = 1e-4) -> DataFrame:
    """id, score for every row. train_fold: over `id`, true for ids whose labels may be learnt.

    sample_rows: labelled rows that are fitted, at most about so many; chosen by the hash of the id.
    features: the best n-grams that are kept though they are not significant.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    usable = sample_labelled(labels_of(labels, id_col, label_col).where(flag(train_fold)), sample_rows)
    # the sample is bounded by sample_rows, so it may be broadcast
    model = train(plain.join(F.broadcast(usable), "id").select("id", "text", "y"), bits, features, penalty)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in chunks(batch, 1):
                yield pa.record_batch({"id": batch.column(0).slice(start, end - start), "score": pa.array(shared.value.scores(data, offsets))})

    return plain.mapInArrow(lean(run), "id long, score double").withColumnRenamed("id", id_col)

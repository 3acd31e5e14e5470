"""Quality: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A document is described by a few statistics of its characters, words and lines. Random Fourier features approximate a
Gaussian kernel over them. Each partition sums its part of the normal equations; the sums, whose size is a parameter,
give the ridge solution. They are summed for each of a few folds apart, so the solution without a fold follows by
subtraction; every labelled row is scored by the solution that has not seen its fold. These scores are binned and made
isotonic (pooled adjacent violators), which turns the scores of the solution over all rows into probabilities. It is
one rule at every size.

Defined results: null text counts as empty; without labels every score is 0.5, with one class its own label; where all
labelled rows are in one fold, they are scored by the solution that has seen them; repeated rows are scored each; an
empty table gives no rows; texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import BLOCK_SCHEMA, CHUNK, LOWER, Bloom, Scratch, block_rows, build_bloom, gather_blocks, lean, let_through, map_rows, quoted, row_chunks, sum_blocks, text_buffer, words_of
from doclens.llm.grams import flag, labels_of

#: Byte classes: 0 lower-case, 1 upper-case, 2 digit, 3 blank, 4 newline, 5 sentence mark, 6 exclamation, 7 bar and
#: other separators, 8 symbol, 9 other ASCII punctuation, 10 not ASCII, 11 control.
CLASSES = np.full(256, 9, np.uint8)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?", "!", "|<>=_~", "#$%&*@^+")):
    CLASSES[[ord(c) for c in _chars]] = _k
CLASSES[128:] = 10
CLASSES[[b for b in range(32) if chr(b) not in "\t\n\r"]] = 11
N_CLASSES, N_STATS = 12, 20
BLOCK = 1 << 13


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[offsets])


def distinct_share(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct keys among a row's keys; 1 for a row without."""
    if not len(keys):
        return np.ones(n_rows)
    order = np.lexsort((keys, rows))
    keys, sorted_rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sorted_rows[1:] != sorted_rows[:-1])
    total = np.bincount(rows, minlength=n_rows)
    return np.where(total, np.bincount(sorted_rows, new, minlength=n_rows) / np.maximum(total, 1), 1.0)


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x N_CLASSES: bytes of each class, counted a chunk at a time."""
    n = len(offsets) - 1
    out = np.zeros(n * N_CLASSES, np.int64)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        rows = np.searchsorted(offsets, np.arange(at, at + len(part)), "right") - 1
        out += np.bincount(rows * N_CLASSES + CLASSES[part], minlength=len(out))
    return out.reshape(n, N_CLASSES).astype(float)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each line, its newline included, and its row: sums of bytes times values of their places, by chunks."""
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        place = np.arange(at, at + len(part))
        line = np.searchsorted(starts, place, "right") - 1
        value = (LOWER[part].astype(np.uint64) + np.uint64(1)) * ((place - starts[line]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        edges = np.flatnonzero(np.diff(line, prepend=-1))
        out[line[edges]] += np.add.reduceat(value, edges)
    return out, np.searchsorted(offsets, starts, "right") - 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x N_STATS, of each whole text. What is kept of a long text are hashes of its words and lines."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    counts = class_counts(data, offsets)
    shares = counts / np.maximum(size, 1)[:, None]
    words, word_rows = words_of(data, offsets)
    n_words = np.bincount(word_rows, minlength=n).astype(float)
    pairs = words[1:] * np.uint64(3) + words[:-1]
    same_row = word_rows[1:] == word_rows[:-1] if len(words) else np.zeros(0, bool)
    repeats = np.bincount(word_rows[1:][same_row & (words[1:] == words[:-1])], minlength=n) if len(words) else np.zeros(n)
    letters = counts[:, 0] + counts[:, 1] + counts[:, 10]
    out = np.column_stack(
        [
            shares,
            np.log1p(n_words),
            letters / np.maximum(n_words, 1) / 10,
            distinct_share(words, word_rows, n),
            distinct_share(pairs[same_row], word_rows[1:][same_row], n) if len(words) else np.ones(n),
            distinct_share(*line_hashes(data, offsets), n),
            repeats / np.maximum(n_words, 1),
            np.log1p(n_words / np.maximum(counts[:, 5], 1)),
            counts[:, 1] / np.maximum(letters, 1),
        ]
    )
    return out.astype(np.float32)


def fourier(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int = 11) -> np.ndarray:
    """rows x (features + 1): cosines of random projections of the standardised statistics, and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(stats.shape[1], features)) / width
    phase = rng.uniform(0, 2 * np.pi, features)
    x = np.clip((stats - mean) / spread, -8, 8)
    return np.column_stack([np.sqrt(2 / features) * np.cos(x @ w + phase), np.ones(len(x))])


def partition_sums(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sum of make(stats, y, fold), a float array of `size`, over all partitions."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            stats = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for k in range(0, len(stats), 1024):
                total += make(stats[k : k + 1024], y[k : k + 1024].astype(float), fold[k : k + 1024])
        yield from block_rows(total, BLOCK)

    return gather_blocks(sum_blocks(rows.select("stats", "y", "fold").mapInArrow(lean(run), BLOCK_SCHEMA), np.float64), size, BLOCK, np.float64)


def isotonic(weights: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators over bins in order: a non-decreasing share of positives per bin."""
    blocks: list[list[float]] = []
    for n, p in zip(weights, positives, strict=True):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in blocks])


class Model:
    """Standardisation, ridge weights, calibration knots."""

    def __init__(self, rows: DataFrame, folds: int, features: int, width: float, ridge: float, bins: int):
        """rows: stats, y, fold (0 to folds - 1)."""
        self.features, self.width = features, width
        self.constant = None
        moments = partition_sums(rows, lambda s, y, f: np.concatenate([[len(y), y.sum()], s.sum(axis=0), (s.astype(float) ** 2).sum(axis=0)]), 2 + 2 * N_STATS)
        n, positive = moments[:2]
        if not n or positive in (0, n):
            self.constant = 0.5 if not n else float(positive > 0)
            return
        self.mean = moments[2 : 2 + N_STATS] / n
        self.spread = np.sqrt(np.maximum(moments[2 + N_STATS :] / n - self.mean**2, 0)) + 1e-3
        d = features + 1
        mean, spread = self.mean, self.spread

        def normal(s, y, fold):
            z, out = fourier(s, mean, spread, features, width), np.zeros((folds, d * d + d))
            for k in np.unique(fold):
                own = z[fold == k]
                out[k] = np.concatenate([(own.T @ own).ravel(), own.T @ y[fold == k]])
            return out.ravel()

        sums = partition_sums(rows, normal, folds * (d * d + d)).reshape(folds, d * d + d)

        def solution(total):
            a = total[: d * d].reshape(d, d).copy()
            a[np.diag_indices(features)] += ridge
            return np.linalg.solve(a, total[d * d :])

        whole = sums.sum(axis=0)
        self.w = solution(whole)
        # the last feature is constant, so its square counts rows
        sizes = sums[:, d * d - 1]
        unseen = np.stack([solution(whole - own) if sizes.sum() - size > 0.5 else self.w for own, size in zip(sums, sizes, strict=True)])

        def binned(s, y, fold):
            z = (fourier(s, mean, spread, features, width) * unseen[fold]).sum(axis=1)
            k = np.clip(((z + 0.5) * bins / 2).astype(int), 0, bins - 1)
            return np.concatenate([np.bincount(k, minlength=bins), np.bincount(k, y, minlength=bins), np.bincount(k, z, minlength=bins)])

        count, pos, total = partition_sums(rows, binned, 3 * bins).reshape(3, bins)
        held = count > 0
        self.knots, self.values = total[held] / count[held], isotonic(count[held], pos[held])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = fourier(stats, self.mean, self.spread, self.features, self.width) @ self.w
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def document_statistics(docs: DataFrame, only: Bloom | None = None) -> DataFrame:
    """(id, text) -> id, stats; of the rows whose id the filter lets through, where there is one."""
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(only.words)

    def run(batches):
        held = None if shared is None else Bloom(shared.value)
        for batch in batches:
            if held is not None:
                batch = batch.filter(pa.array(let_through(held, batch.column(0))))
            data, offsets = text_buffer(batch.column(1))
            for start, end in row_chunks(offsets):
                stats = statistics(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                lengths = np.arange(0, (end - start + 1) * N_STATS, N_STATS)
                yield pa.record_batch({"id": batch.column(0).slice(start, end - start), "stats": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(stats.ravel()))})

    return docs.mapInArrow(lean(run), "id long, stats array<float>")


class Fit:
    """The model, and in `stats` the table of statistics it was fitted on: of all documents, or of labelled ones only."""

    def __init__(self, docs: DataFrame, labels: DataFrame, train_fold: Column, fold: Column, id_col: str, text_col: str, label_col: str, labelled_only: bool, folds: int, features: int, width: float, ridge: float, bins: int):
        scratch = Scratch(docs.sparkSession, "quality")
        plain = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
        known = scratch.table(labels_of(labels, id_col, label_col).where(flag(train_fold)).withColumn("fold", F.pmod(fold.cast("int"), F.lit(folds))), "known")
        if labelled_only:
            bloom = build_bloom(known.select("id"), known.count())
            made = document_statistics(plain, bloom) if bloom else document_statistics(plain.join(known.select("id"), "id", "left_semi").select("id", "text"))
        else:
            made = document_statistics(plain)
        self.stats = scratch.table(made, "stats")
        rows = scratch.table(self.stats.join(known, "id").select("stats", "y", "fold"), "train")
        self.model = Model(rows, folds, features, width, ridge, bins)
        scratch.drop(known, rows)
        if labelled_only:
            scratch.drop(self.stats)


def score_quality(docs: DataFrame, labels: DataFrame, train_fold: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, features: int = 256, width: float = 4.0, ridge: float = 1.0, bins: int = 512) -> DataFrame:
    """id, score for every row. train_fold, fold: over `id`; labels of the first are learnt, in folds by the second."""
    made = Fit(docs, labels, train_fold, fold, id_col, text_col, label_col, False, folds, features, width, ridge, bins)
    shared = docs.sparkSession.sparkContext.broadcast(made.model)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
            for k in range(0, len(x), 1024):
                yield pa.record_batch({"id": batch.column(0).slice(k, 1024), "score": pa.array(shared.value.scores(x[k : k + 1024]))})

    return made.stats.mapInArrow(lean(run), "id long, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, train_fold: Column, fold: Column, threshold: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, features: int = 256, width: float = 4.0, ridge: float = 1.0, bins: int = 512) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; texts are read again, nothing is joined."""
    model = Fit(docs, labels, train_fold, fold, id_col, text_col, label_col, True, folds, features, width, ridge, bins).model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    column = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(column))
            for start, end in row_chunks(offsets):
                stats = statistics(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                yield batch.slice(start, end - start).filter(pa.array(shared.value.scores(stats) >= threshold))

    return map_rows(docs, run)

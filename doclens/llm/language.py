"""Language identification in two stages: the family first, then linear support vector machines within it.

Texts become relative frequencies of hashed 2- and 3-byte n-grams. Families of languages are a parameter; languages
that it does not name form a family of their own. Between families, and between the languages of the chosen family,
one-versus-one linear SVMs vote. They are fitted on a sample of labelled rows of bounded size.

Defined results: null texts and texts without a letter are `und` with score 0; without labelled rows every text is
`und`; with one learnt language it is always predicted; repeated rows are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, lean, quoted, row_chunks, text_buffer
from doclens.llm.grams import STREAM, flag, gram_cells, sample_labelled

#: Families of related languages, by code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
SIZES, BITS = (2, 3), 11
LETTER = regex.compile(r"\p{L}")


def family_of(lang: str, families: dict[str, tuple[str, ...]]) -> str:
    return next((name for name, own in families.items() if lang in own), f"other:{lang}")


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x cells: shares of each cell among a row's n-grams; n-grams across rows are left out."""
    n_rows, cells = len(offsets) - 1, 1 << BITS
    out = np.zeros(n_rows * cells, np.float32)
    stream = STREAM[data]
    rows = np.repeat(np.arange(n_rows), np.diff(offsets)) * cells
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for n in SIZES:
        found = gram_cells(stream, n, BITS)
        m = len(found)
        inside = np.arange(m) + n <= ends[:m]
        out += np.bincount((rows[:m] + found)[inside], minlength=len(out))
    out = out.reshape(n_rows, cells)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def small_chunks(batch: pa.RecordBatch, column: int, most_rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most about 1 MB and 256 rows. A longer text is one run, its histogram is built piece by piece."""
    data, offsets = text_buffer(batch.column(column))
    for a, b in row_chunks(offsets):
        for start in range(a, b, most_rows):
            end = min(b, start + most_rows)
            yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]


def features_of(data: np.ndarray, offsets: np.ndarray, window: int = 1 << 22) -> np.ndarray:
    if len(offsets) == 2 and len(data) > window:
        parts = [data[k : k + window + max(SIZES) - 1] for k in range(0, len(data), window)]
        own = np.array([frequencies(p, np.array([0, len(p)]))[0] * len(p) for p in parts])
        return (own.sum(axis=0) / sum(map(len, parts)))[None, :].astype(np.float32)
    return frequencies(data, offsets)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ASCII letters are seen in the bytes; texts without any but with other characters are decoded."""
    low = data | 32
    letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    found = np.diff(letters[offsets]) > 0
    for row in np.flatnonzero(~found & (np.diff(wide[offsets]) > 0)):
        found[row] = LETTER.search(data[offsets[row] : offsets[row + 1]].tobytes().decode()) is not None
    return found


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear SVM with hinge loss by dual coordinate descent; y is -1 or 1, the intercept is one more feature."""
    norms = (x**2).sum(axis=1) + 1.0
    alpha, w, b = np.zeros(len(y)), np.zeros(x.shape[1]), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (x[i] @ w + b) - 1
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == cost and g <= 0):
                continue
            new = min(max(alpha[i] - g / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            worst, alpha[i] = max(worst, abs(g)), new
            w += step * x[i]
            b += step
        if worst < 1e-3:
            break
    return w, b


class Machines:
    """One-versus-one machines between the members of a group: votes, then summed margins."""

    def __init__(self, names: list[str], x: np.ndarray, y: list[str]):
        self.names, y = names, np.array(y)
        self.pairs, rows = [], []
        for a, b in itertools.combinations(range(len(names)), 2):
            mask = (y == names[a]) | (y == names[b])
            rows.append(fit_svm(x[mask], np.where(y[mask] == names[a], 1.0, -1.0)))
            self.pairs.append((a, b))
        self.w = np.array([w for w, _ in rows]) if rows else np.zeros((0, x.shape[1]))
        self.b = np.array([b for _, b in rows])

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its confidence, 0 to 1."""
        votes = np.zeros((len(x), len(self.names)))
        least = np.full((len(x), len(self.names)), np.inf)
        margins = x @ self.w.T + self.b
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += (m >= 0) + 0.49 * np.tanh(m) / len(self.names)
            votes[:, b] += (m < 0) - 0.49 * np.tanh(m) / len(self.names)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        winner = votes.argmax(axis=1)
        return winner, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(x)), winner], -50, 50)))


class Model:
    """Scaling, machines between families, machines within each family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]):
        self.scale = 1 / np.sqrt(x.var(axis=0) + 1e-8) / np.sqrt(x.shape[1])
        self.mean = x.mean(axis=0)
        x = (x - self.mean) * self.scale
        own = [family_of(lang, families) for lang in langs]
        names = sorted(set(own))
        self.between = Machines(names, x, own)
        self.within = []
        for name in names:
            rows = [i for i, f in enumerate(own) if f == name]
            self.within.append(Machines(sorted({langs[i] for i in rows}), x[rows], [langs[i] for i in rows]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (x - self.mean) * self.scale
        family, sure = self.between.decide(x)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for k, machines in enumerate(self.within):
            rows = np.flatnonzero(family == k)
            if len(rows):
                winner, own = machines.decide(x[rows])
                lang[rows] = np.array(machines.names, object)[winner]
                score[rows] = sure[rows] * own
        return lang, score


def train(sample: DataFrame, families: dict[str, tuple[str, ...]]) -> Model | None:
    """sample: (text, lang), of bounded size."""

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in small_chunks(batch, 0):
                rows = [r.tobytes() for r in features_of(data, offsets)]
                yield pa.record_batch({"lang": batch.column(1).slice(start, end - start), "x": pa.array(rows, pa.binary())})

    rows = sample.select("text", "lang").mapInArrow(lean(run), "lang string, x binary").collect()
    # the machines see the rows in one order, whatever files and tasks they came from
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not rows:
        return None
    return Model(np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]), [r["lang"] for r in rows], families)


def identify_language(docs: DataFrame, train_fold: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 5_000, families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id, lang_pred, score for every row. train_fold: over `id`, true for rows whose language may be learnt.

    sample_rows: labelled rows that are fitted, at most about so many; chosen by the hash of the id.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang"))
    known = plain.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & flag(train_fold))
    model = train(sample_labelled(known, sample_rows), FAMILIES if families is None else families)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            nulls = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for start, end, data, offsets in small_chunks(batch, 1):
                lang, score = np.full(end - start, "und", object), np.zeros(end - start)
                ok = has_letter(data, offsets) & ~nulls[start:end]
                if shared.value is not None and ok.any():
                    pred, sure = shared.value.predict(features_of(data, offsets))
                    lang[ok], score[ok] = pred[ok], sure[ok]
                yield pa.record_batch({"id": batch.column(0).slice(start, end - start), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return plain.select("id", "text").mapInArrow(lean(run), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)

"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators say which n-grams a text holds, not how often.  Each is scaled by the log ratio of its
smoothed rates in the two classes, and a linear model with hinge loss is fitted to the scaled
indicators by dual coordinate descent; margins become probabilities through a logistic curve
fitted to rows the model has not seen.  N-grams are taken of words and of word shapes (``Xx,``,
``X!!``, a mark for a word that repeats the one before), so invented words are no obstacle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import slices

#: Hashed features.
N_FEATURES = 1 << 18
#: The model is fitted to at most so many rows, those with the smallest hashes.
SAMPLE_ROWS = 8_000
#: Words whose shapes are kept, in each of two generations; how many there are changes no result.
MAX_KEPT_WORDS = 100_000
#: Longer runs without white space are read as several words of so many characters.
WORD_CHARS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(zlib.crc32(b"repeated word"))


class _Kinds(dict):
    """Code point -> X, x, 9 or itself, filled when met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        self[code] = kind
        return kind


_KINDS = _Kinds()
#: Runs within a shape: letters of a kind and digits count once, other characters at most twice.
_RUNS = re.compile(r"(x)x+|(9)9+|(X)X+x+|(XX)X+|(.)\5{2,}")


def _short(run: re.Match) -> str:
    x, nine, capital, capitals, other = run.groups()
    return x or nine or (capital and "Xx") or capitals or other * 2


class Indicators:
    """Feature numbers of a text's words, shapes, shape pairs and shape triples."""

    def __init__(self, n_features: int = N_FEATURES):
        self.bits = np.uint64(64 - (n_features.bit_length() - 1))
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    @staticmethod
    def shape(word: str) -> str:
        return _RUNS.sub(_short, word.translate(_KINDS))

    def _word(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = (zlib.crc32(self.shape(word).encode()) << 31
                     | zlib.crc32(word.encode()) >> 1)
        self.kept[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        words, kept = text.split(), self.kept
        if max(map(len, words), default=0) > WORD_CHARS:
            words = [w[at:at + WORD_CHARS] for w in words for at in range(0, len(w), WORD_CHARS)]
        if len(kept) > MAX_KEPT_WORDS:
            self.older, self.kept = kept, {}
            kept = self.kept
        packed = np.array([kept.get(w) or self._word(w) for w in words], np.uint64)
        same = np.zeros(len(packed), bool)
        same[1:] = packed[1:] == packed[:-1]
        shapes = np.where(same, _REPEAT, packed >> np.uint64(31))
        pairs = shapes[:-1] * np.uint64(31) + shapes[1:]
        triples = pairs[:-1] * np.uint64(31) + shapes[2:]
        hashed = [(grams * np.uint64(8) + np.uint64(kind)) * _MIX >> self.bits
                  for kind, grams in enumerate((packed & np.uint64(0x7FFFFFFF), shapes, pairs, triples))]
        return np.unique(np.concatenate(hashed)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))

    def margin(self, features: np.ndarray) -> float:
        """Indicators count by the root of their number, so that long texts do not stand out."""
        return float(self.weights[features].sum() / max(1.0, len(features)) ** 0.5 + self.bias)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, n_features: int) -> np.ndarray:
    counts = np.ones((2, n_features))
    for row, label in zip(rows, labels):
        counts[int(label), row] += 1
    totals = np.bincount(labels.astype(int), minlength=2) + 2
    return np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray,
                            n_features: int, cost: float = 1.0, epochs: int = 20,
                            seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM; a row's class is weighted by its rarity."""
    signs = np.where(labels > 0, 1.0, -1.0)
    share = np.bincount(labels.astype(int), minlength=2) / max(1, len(labels))
    bound = cost * np.where(labels > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    norms = np.array([(v * v).sum() + 1.0 for v in values])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(n_features), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i])
            if change := (new - alpha[i]) * signs[i]:
                weights[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
                largest = max(largest, abs(change))
        if largest < 1e-4:
            break
    return weights, bias


def fit_logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    positive = labels.sum()
    targets = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    design = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - targets))
        theta = theta - step
        if abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(texts: list[str], labels: np.ndarray, n_features: int = N_FEATURES) -> Model:
    """Fit on four fifths of the rows, then the curve on the rest.

    One class alone, or no rows at all, gives a constant model: that class's score is 1 (or 0).
    """
    labels = np.asarray(labels, float)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(n_features), 0.0, 1.0,
                     0.0 if not len(labels) else 30.0 if labels[0] > 0 else -30.0)
    indicators = Indicators(n_features)
    rows = [indicators(t) for t in texts]
    fifth = np.arange(len(rows)) % 5 == 4
    if len(np.unique(labels[fifth])) < 2 or len(np.unique(labels[~fifth])) < 2:
        fifth = np.zeros(len(rows), bool)
    seen = [i for i in range(len(rows)) if not fifth[i]]
    ratios = log_count_ratios([rows[i] for i in seen], labels[seen], n_features)
    values = [ratios[rows[i]] / max(1.0, len(rows[i])) ** 0.5 for i in seen]
    weights, bias = dual_coordinate_descent(
        [rows[i] for i in seen], values, labels[seen], n_features)
    model = Model(weights * ratios, bias, 1.0, 0.0)
    rest = np.flatnonzero(fifth) if fifth.any() else np.arange(len(rows))
    margins = np.array([model.margin(rows[i]) for i in rest])
    return Model(model.weights, bias, *fit_logistic(margins, labels[rest]))


def fold(doc_id: Column) -> Column:
    """A document's fold, 0 to 4; fold 0 is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled documents outside fold 0, at most ``sample_rows`` of them by hash.

    Documents or labels without an id, and null labels, are not learnt from; null texts count as
    empty.  A document with several labels is learnt from once for each.
    """
    labelled = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(
        (fold(F.col("doc_id")) != 0) & F.col("_label").isin(0, 1))
    # The rows are chosen by ids alone; only the chosen ones' texts are moved.
    chosen = labelled.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(
        F.xxhash64("doc_id"), "doc_id", "_label").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id").orderBy(  # bounded by sample_rows
        F.xxhash64("doc_id"), "doc_id", "_label", "text").select("text", "_label").limit(
        2 * sample_rows).toPandas()
    return train(rows["text"].tolist(), rows["_label"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The whole ``text`` is read; null counts as empty, and an empty text has a score too.  Columns
    of these two names are replaced, others pass.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, indicators = shared.value, Indicators()
        for batch in slices(batches):
            margins = [model.margin(indicators(x.as_py() or "")) for x in batch.column(at)]
            scores = model.scores(np.array(margins, float))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, f"{fields}, score double, predicted int")

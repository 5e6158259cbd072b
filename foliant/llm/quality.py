"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled web text, a mixture whose
share of good documents (the class prior) is estimated.  The classifier minimises the non-negative
unbiased risk: the positives' loss, and the unlabelled loss as negatives less the part that the
positives in it explain, held at zero from below so that a flexible model can't drive it negative.

The model is additive over binned text statistics.  It is fitted on the driver from bounded samples
(parameters below); scoring is one pass over all documents.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, filter_arrow, map_arrow

FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper_share", "digit_share", "symbol_share", "white_share", "distinct_words", "distinct_pairs",
    "adjacent_repeats", "top_word_share", "symbol_words", "upper_words", "sentence_length", "line_length", "distinct_lines", "high_bytes", "letter_entropy",
)
#: Most rows of the two training samples.
POSITIVES, UNLABELLED = 15_000, 30_000
LEAST_ROWS = 20
#: Parts of the samples for the estimate of the class prior, and the weight decay of its classifiers.
FOLDS, PRIOR_L2 = 5, 1e-3
#: Most bins of a feature, and the positives that each should have.
BINS, ROWS_PER_BIN = 24, 25

_UPPER, _LOWER, _DIGIT, _WHITE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _WHITE | _HIGH)
_END = tuple(".!?")


def statistics(text: str) -> list[float]:
    """The features of one text; all are defined for an empty one (zeros)."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode(), np.uint8)
    histogram = np.bincount(data, minlength=256)
    size, n = len(data), len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = set(zip(words, words[1:]))
    letters = histogram[histogram > 0] / size
    lines = [x for x in text.split("\n") if x]
    kinds = list(counts)
    return [
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        histogram[_UPPER].sum() / size,
        histogram[_DIGIT].sum() / size,
        histogram[_SYMBOL].sum() / size,
        histogram[_WHITE].sum() / size,
        len(counts) / n,
        len(pairs) / max(1, n - 1),
        sum(map(str.__eq__, words, words[1:])) / n,
        counts.most_common(1)[0][1] / n,
        sum(counts[w] for w in kinds if not w[-1].isalnum() and w[-1] not in ".,;:?") / n,
        sum(counts[w] for w in kinds if w.isupper() and len(w) > 1) / n,
        n / (1 + sum(counts[w] for w in kinds if w.endswith(_END))),
        n / len(lines) if lines else n,
        len(set(lines)) / len(lines) if lines else 1.0,
        histogram[_HIGH].sum() / size,
        float(-(letters * np.log2(letters)).sum()),
    ]


@dataclass
class Model:
    edges: list[np.ndarray]  # inner bin borders of each feature
    weights: list[np.ndarray]  # a weight for each bin
    bias: float
    prior: float

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binned(rows)
        return self.bias + sum(w[bins[:, j]] for j, w in enumerate(self.weights))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 1500, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk; without a prior, on positives against unlabelled (for its estimate)."""
    both = np.concatenate([positive, unlabelled])
    bins = int(np.clip(len(positive) / ROWS_PER_BIN, 4, BINS))
    edges = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(both.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], 0.0, prior or 0.5)
    sizes = [len(w) for w in model.weights]
    starts = np.cumsum([0, *sizes[:-1]])
    total = sum(sizes)
    at_p, at_u = model.binned(positive) + starts, model.binned(unlabelled) + starts
    theta, m, v = np.zeros(total + 1), np.zeros(total + 1), np.zeros(total + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def back(at: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at.ravel(), weights=np.repeat(slope, at.shape[1]), minlength=total), slope.sum())

    for t in range(1, steps + 1):
        gp, gu = theta[at_p].sum(1) + theta[-1], theta[at_u].sum(1) + theta[-1]
        pull = -sigmoid(-gp) / len(gp)  # slope of the positives' loss as positives
        if prior is None:
            gradient = 0.5 * back(at_p, pull) + 0.5 * back(at_u, sigmoid(gu) / len(gu))
        else:
            as_negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            negative = back(at_u, sigmoid(gu) / len(gu)) - prior * back(at_p, sigmoid(gp) / len(gp))
            gradient = prior * back(at_p, pull) + negative if as_negative >= 0 else -negative
        gradient[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.bias = [theta[s : s + n] for s, n in zip(starts, sizes)], float(theta[-1])
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows: the densest region of positives against unlabelled bounds it.

    A classifier of positives against unlabelled ranks the rows.  At every rank threshold the positives' rate above
    it is known, and the unlabelled rate above it is at least the prior times that; the least ratio over
    thresholds that keep most positives, less its standard error, is the estimate: every ratio is an upper bound,
    and the risk bears too small a prior better than too large a one.
    """
    p_scores, u_scores = [], []
    for fold in range(FOLDS):  # each part is ranked by the classifier of the others
        rest = lambda rows: np.concatenate([rows[k::FOLDS] for k in range(FOLDS) if k != fold])  # noqa: E731, B023
        model = _fit(rest(positive), rest(unlabelled), None, steps=400, l2=PRIOR_L2)
        p_scores.append(model.logits(positive[fold::FOLDS]))
        u_scores.append(model.logits(unlabelled[fold::FOLDS]))
    best = 1.0
    for cut in np.linspace(0.02, 0.3, 15):
        cuts = [np.quantile(p, cut) for p in p_scores]
        above_p = np.mean([(p >= c).mean() for p, c in zip(p_scores, cuts)])
        above_u = np.mean([(u >= c).mean() for u, c in zip(u_scores, cuts)])
        ratio = above_u / max(above_p, 1e-9)
        error = ratio * np.sqrt((1 - above_p) / max(above_p * len(positive), 1e-9) + (1 - above_u) / max(above_u * len(unlabelled), 1e-9))
        best = min(best, ratio - error)
    return float(np.clip(best, 0.05, 0.99))


def _sample_statistics(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Features of the documents with the given ids (a bounded table, broadcast)."""

    def make():
        def step(batch: pa.RecordBatch):
            yield {"x": [statistics(t or "") for t in batch.column(0).to_pylist()]}

        return step

    rows = map_arrow(docs.join(F.broadcast(ids), id_col, "left_semi").select(text_col), make, "x array<double>").toPandas()["x"]
    return np.array(rows.tolist(), dtype=float).reshape(-1, len(FEATURES))


def open_rows_with(frame: DataFrame, id_col: str, modulus: int, held_out: int) -> DataFrame:
    """Rows with an id outside the held-out fold."""
    return frame.filter(F.col(id_col).isNotNull() & (crc_remainder(id_col, modulus) != held_out))


def train(
    docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held_out: int = 2, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Fit on at most ``positives`` labelled good rows and ``unlabelled`` others, none of them of the held-out fold.

    The samples are the rows with the least hashes of their ids, so they don't depend on partitions.  Rows
    labelled otherwise belong to the unlabelled text; no label but the good ones is used.  With fewer than
    LEAST_ROWS of either sample there is nothing to learn from: every document scores 0.73 and stays.
    """
    open_rows = lambda frame: open_rows_with(frame, id_col, modulus, held_out).select(id_col)
    good = open_rows(labels.filter(F.col(label_col) == 1)).distinct()
    first = lambda frame, n: frame.orderBy(F.xxhash64(id_col), id_col).limit(n)
    p = _sample_statistics(docs, first(good, positives), id_col, text_col)
    u = _sample_statistics(docs, first(open_rows(docs).distinct(), unlabelled), id_col, text_col)
    if len(p) < LEAST_ROWS or len(u) < LEAST_ROWS:
        return Model([np.array([]) for _ in FEATURES], [np.zeros(1) for _ in FEATURES], 1.0, 0.5)
    order = np.random.default_rng(7)
    p, u = order.permutation(p), order.permutation(u)
    return _fit(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model, *, modulus: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row.

    Null texts count as empty, whose statistics are zeros.  Repeated rows and null ids come back as they came
    (a null id is never held out); an empty table gives an empty result; other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch):
            rows = np.array([statistics(t or "") for t in batch.column(1).to_pylist()])
            found = model.score(rows)
            yield {id_col: batch.column(0), "held_out": batch.column(2), "score": pa.array(found), "predicted": pa.array((found >= threshold).astype(np.int32))}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col, (crc_remainder(id_col, modulus) == held_out).alias("held_out")), make, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score at least ``threshold``, in all their columns."""
    at = docs.columns.index(text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array(model.score(rows) >= threshold))

    return filter_arrow(docs, step)

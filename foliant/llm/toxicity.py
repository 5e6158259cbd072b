"""Toxicity scores of restored text: a noisy-channel decoder, then a linear model of words.

Toxic words hide behind digits and signs ("m0r0n"), separators ("m.o.r.o.n", "m o r o n") and repetition
("mooooron").  The decoder builds a lattice of characters that a written token may stand for and finds its
most likely path by Viterbi under a character trigram model of all documents and channel costs for each
change.  A run of single characters between spaces is one token, whose spaces may be dropped or stay as word
borders.  Only tokens that show such signs are decoded, whole and whatever their length; others are their own
best path.  The score is a logistic model over words and word beginnings of the restored text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, map_arrow, text_of

# What a written character may stand for besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i",
}
#: Costs in nats: a substitution, a dropped separator, a dropped repeat, a space between single characters that borders a word.
SUBSTITUTED, DROPPED, REPEATED, BORDER = 0.7, 0.4, 0.2, 1.5
SEPARATORS = "._-*~'`,·"
LEAST_BEGINNING, LONGEST_BEGINNING = 4, 6
#: Most labelled rows the model is fitted on, and most features it keeps.
LABELLED, KEPT_FEATURES = 40_000, 4_000
KEPT_WORDS = 400_000
#: A whole word's own odds count, divided by DISCOUNT, if so many toxic rows have it and at most a twentieth as many others.
LEAST_DOCUMENTS, DISCOUNT = 12, 5

_ODD = re.compile(r"[^\W\d_][" + re.escape("".join(STANDS_FOR) + SEPARATORS) + r"]+[^\W\d_]|[" + re.escape("".join(STANDS_FOR)) + r"]+[^\W\d_]{2}|([^\W\d_])\1\1|[^\W\d_]{2}[0-9@$|]+$")
_SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
_EDGE = ".,;:?!\"()[]{}<>*#%&~'`-_"


#: The letters of the character model; 0 is the border of a word, the last code any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())
CODE = {c: n for n, c in enumerate(LETTERS, 1)}
SIZE = len(LETTERS) + 2
_CODES = np.array([CODE.get(c, SIZE - 1 if c.isalpha() else 0) for c in map(chr, range(0x3100))] + [SIZE - 1], np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Counts [before-last, last, next] of the letters and word borders of a lower-case text, flat."""
    codes = _CODES[np.minimum(np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32), 0x3100)].astype(np.int32)
    a, b, c = np.concatenate(([0], codes[:-2])), codes[:-1], codes[1:]
    a = np.where(b == 0, 0, a)  # a word's first letter knows nothing of the word before
    return np.bincount(((a * SIZE + b) * SIZE + c)[(b > 0) | (c > 0)], minlength=SIZE**3)


@dataclass
class CharacterModel:
    """Interpolated character trigrams, smoothed by bigrams and a uniform share."""

    cost: list  # [before-last][last][next] in nats

    @classmethod
    def learned(cls, counts: np.ndarray) -> CharacterModel:
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * SIZE)
        p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
        p3 = (three + 2 * p2) / (three.sum(2, keepdims=True) + 2)
        return cls((-np.log(p3)).tolist())

    def text_cost(self, text: str) -> float:
        """The cost of a reading: of its words, borders included."""
        found = 0.0
        for word in text.split(" "):
            codes = [0, 0, *[CODE.get(c, SIZE - 1) for c in word], 0]
            found += sum(self.cost[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))
        return found


def options(c: str, ends: bool) -> tuple[list[tuple[str, float]], float | None]:
    """What a written character may be read as, with costs, and the cost of dropping it (None: it may not be dropped)."""
    if c == " ":
        return [(" ", BORDER)], 0.0
    readings = [(x, SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
    if c.isalpha() or not readings and c not in SEPARATORS:
        readings.append((c, 0.0))
    return readings, DROPPED if c in SEPARATORS or (not c.isalpha() and ends) else None


def restore(token: str, model: CharacterModel, readings_kept: int = 3) -> list[str]:
    """The most likely readings of one written token (lower case), the best first: Viterbi over all paths.

    A path's state is its last two codes and its last letter; each state keeps its best path as a chain of
    letters, so the work is linear in the token.
    """
    table, last_code = model.cost, SIZE - 1
    paths: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for place, c in enumerate(token):
        readings, dropped = options(c, place + 1 == len(token))
        coded = [(x, change, CODE.get(x, last_code), c.isalpha() or change > 0) for x, change in readings]
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (a, b, last), (cost, chain) in paths.items():
            found = []
            for letter, change, code, repeats in coded:
                if letter == " ":
                    found.append(((0, 0, " "), cost + change + table[a][b][0], (chain, " ")))
                    continue
                found.append(((b, code, letter), cost + change + table[a][b][code], (chain, letter)))
                if letter == last and repeats:
                    found.append(((a, b, last), cost + REPEATED + change, chain))
            if dropped is not None:
                found.append(((a, b, last), cost + dropped, chain))
            for state, total, path in found:
                if state not in after or total < after[state][0]:
                    after[state] = (total, path)
        paths = after
    ended = sorted(((cost + table[a][b][0], n, chain) for n, ((a, b, _), (cost, chain)) in enumerate(paths.items())), key=lambda x: x[:2])
    texts: dict[str, None] = {}
    for _, _, chain in ended:
        letters = []
        while chain is not None:
            chain, letter = chain
            letters.append(letter)
        texts.setdefault("".join(reversed(letters)))
        if len(texts) == readings_kept:
            break
    return list(texts)


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens between white space; a run of single characters between spaces is one token, spaces included."""
    lower = text.lower()
    out, at = [], 0
    for m in _SPACED.finditer(lower):
        out += lower[at : m.start()].split()
        out.append(m[0])
        at = m.end()
    return out + lower[at:].split() if out else lower.split()


@dataclass
class Model:
    characters: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def restored(self, token: str) -> tuple[str, ...]:
        """The words a written token may be scored as: stripped as it is and, if it looks disguised, its best readings."""
        plain = token.strip(_EDGE)
        if " " in token:
            return tuple(dict.fromkeys(word for reading in restore(token, self.characters) for word in reading.split()))
        if _ODD.search(token):
            return tuple(dict.fromkeys([plain, *restore(token.strip(".,;:?\"()[]{}<>#%&"), self.characters)]))
        return (plain,)

    def features(self, token: str) -> tuple[str, ...]:
        """Names of the weighted features of one token."""
        if (found := self.known.get(token)) is None:
            found = tuple(f for word in self.restored(token) for f in names_of(word) if f in self.weights)
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = found
        return found

    def score(self, text: str) -> float:
        found = {f for token in set(tokens_of(text)) for f in self.features(token)}
        logit = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, logit))))


def names_of(word: str) -> list[str]:
    """A word and its beginnings as feature names."""
    return [f"={word}", *(word[:n] + "*" for n in range(LEAST_BEGINNING, min(len(word), LONGEST_BEGINNING + 1)))] if word else []


def _labelled(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, limit: int, id_col: str, label_col: str) -> DataFrame:
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_remainder(id_col, modulus) != held_out))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    return known.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def train(
    docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held_out: int = 0, labelled: int = LABELLED, kept: int = KEPT_FEATURES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on at most ``labelled`` rows outside the held-out fold (those with the least hashes of their ids).

    The character model counts all documents; no label has a part in it.  The choice of features are sums over
    the labelled rows, made on the executors; the driver gets the ``kept`` most telling features and the rows'
    use of them.  A whole word that tells nearly alone what its documents are keeps at least part of its own
    odds (DISCOUNT): joint fitting splits the weight of words that come together in the sample, and a document
    with one of them alone would fall below one half.
    """
    sample = docs.select(id_col, text_of(text_col).alias("_text")).join(F.broadcast(_labelled(docs, labels, modulus, held_out, labelled, id_col, label_col)), id_col)

    def letters():
        held = np.zeros(SIZE**3, np.int64)

        def step(batch: pa.RecordBatch | None):
            if batch is not None:
                held[:] += trigrams(" ".join(t for t in batch.column(0).to_pylist() if t).lower())
            elif (at := np.flatnonzero(held)).size:
                yield {"gram": pa.array(at), "n": pa.array(held[at])}

        return step

    # at most SIZE to the third power rows
    grams = map_arrow(docs.select(text_col), letters, "gram int, n bigint", 2 << 20, closing=True).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3)
    counts[grams["gram"].to_numpy()] = grams["n"].to_numpy()
    model = Model(CharacterModel.learned(counts))

    def used():
        def step(batch: pa.RecordBatch):
            rows: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for token in set(tokens_of(text)) for word in model.restored(token) for f in names_of(word)}:
                    rows[f, toxic] = rows.get((f, toxic), 0) + 1
            yield {"f": [f for f, _ in rows], "toxic": [t for _, t in rows], "n": list(rows.values())}

        return step

    totals = dict(sample.groupBy("_toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:  # one class only: its share, smoothed, is every document's score
        model.bias = log((bad + 1) / (good + 1))
        return model
    counts = map_arrow(sample.select("_text", F.col("_toxic").cast("int")), used, "f string, toxic int, n bigint", 64 << 20).groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    lift = F.log((F.col("bad") + 0.1) / bad) - F.log((F.col("good") + 0.1) / good)
    chosen = counts.filter((F.col("bad") >= 4) & (lift > 2)).orderBy(F.desc(lift * F.log1p("bad")), "f").limit(kept).collect()
    model.weights = {r["f"]: 0.0 for r in chosen}
    order = {f: i for i, f in enumerate(model.weights)}

    def rows_of():
        def step(batch: pa.RecordBatch):
            found = [sorted({order[f] for token in set(tokens_of(t)) for f in model.features(token)}) for t in batch.column(0).to_pylist()]
            yield {"x": found, "toxic": batch.column(1)}

        return step

    rows = map_arrow(sample.select("_text", F.col("_toxic").cast("int")), rows_of, "x array<int>, toxic int").groupBy("x", "toxic").count().collect()
    _fit(model, rows)
    for r in chosen:
        if r["f"].startswith("=") and r["bad"] >= max(LEAST_DOCUMENTS, 20 * r["good"]):
            alone = log((r["bad"] + 0.5) / (r["good"] + 0.5)) - log(DISCOUNT) - model.bias
            model.weights[r["f"]] = max(model.weights.get(r["f"], 0.0), alone)
    return model


def _fit(model: Model, rows: list, steps: int = 3000, rate: float = 0.1, l2: float = 3e-6) -> None:
    """Logistic regression by full-batch Adam; equal rows come once, with their count."""
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.array([r["count"] for r in rows], float)
    weight /= weight.sum()
    owner = np.repeat(np.arange(len(rows)), [len(r["x"]) for r in rows])
    at = np.array([i for r in rows for i in r["x"]], dtype=int)
    size = len(model.weights)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        logit = theta[-1] + np.bincount(owner, weights=theta[at], minlength=len(rows))
        slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        gradient = np.append(np.bincount(at, weights=slope[owner], minlength=size) + l2 * theta[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    model.weights = {f: float(w) for f, w in zip(model.weights, theta) if abs(w) > 1e-3}
    model.bias = float(theta[-1])
    model.known.clear()


def score(docs: DataFrame, model: Model, *, modulus: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score of one half or more) for each row.

    Null and empty texts get the model's bias.  Repeated rows and null ids come back as they came (a null id
    is never held out); an empty table gives an empty result; other columns are not read.
    """

    def make():
        def step(batch: pa.RecordBatch):
            found = np.array([model.score(t or "") for t in batch.column(1).to_pylist()])
            yield {id_col: batch.column(0), "held_out": batch.column(2), "score": pa.array(found), "predicted": pa.array((found >= 0.5).astype(np.int32))}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col, (crc_remainder(id_col, modulus) == held_out).alias("held_out")), make, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

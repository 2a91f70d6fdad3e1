"""Quality scores from random-indexing word vectors and a small network.

Fitting. At most ``PER_CLASS`` labelled documents of each class, the first in the order of a hash of their
id, are brought to the driver (the documented bound of the sample). Every word kept for the vocabulary has
a fixed sparse ternary index vector; its word vector is the sum of the index vectors of its neighbours in the
sample, scaled to length one. Words outside the vocabulary are taken by their shape (case, digits and marks),
which is a word of its own. A document's input is the mean of its words' vectors, the mean of its shapes'
vectors, and four plain measures (length, unknown share, distinct share, whether it has words). A network of
one hidden and one output layer is trained with Adam; rows weigh as often as their class occurs among the
labels. One fifth of the sample sets the temperature that calibrates the probabilities.

Scoring. The model (bounded by VOCABULARY) goes to the tasks; every whole text is scored in Arrow batches
without a shuffle. Only the text is an input of a score.

Defined cases: null and empty texts have the score of a document without words; labels that are null are left
out, a document with several labels has the least; without labels every score is 0.5, with one class alone it
is the smoothed share of that class; repeated rows have equal scores; empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import crc_mod
from callweave.llm.shingles import distinct

PER_CLASS = 2000
VOCABULARY = 40_000
LEAST_COUNT = 3
DIM = 32
NONZERO = 4
WINDOW = 2
HIDDEN = 24
EPOCHS = 60
SEED = 7
#: Characters of the texts whose words are numbered together.
PIECE = 1_000_000

_SHAPES = str.maketrans(
    {**{c: "A" for c in map(chr, range(65, 91))}, **{c: "a" for c in map(chr, range(97, 123))}, **{c: "0" for c in "0123456789"}}
)
_RUNS = re.compile(r"(.)\1+", re.S)


@lru_cache(100_000)
def _form(shown: str) -> str:
    """What is left of a word whose ASCII letters and digits are shown by their classes."""
    if not shown.isascii():
        shown = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in shown)
    return _RUNS.sub(r"\1", shown)[:8]


def shape(word: str) -> str:
    """Case, digits and marks of a word, with runs cut to one: ``Ab12!!`` gives ``Aa0!``."""
    return _form(word.translate(_SHAPES))


@dataclass
class Model:
    words: dict[str, int]
    shapes: dict[str, int]
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float
    constant: float | None = None

    def inputs(self, texts: Sequence[str | None]) -> np.ndarray:
        """A row of inputs for each text. The distinct words of some texts at a time are looked up once."""
        out = np.zeros((len(texts), 2 * DIM + 4), np.float64)
        begin = 0
        while begin < len(texts):
            number: defaultdict[str, int] = defaultdict(count().__next__)
            told: list[np.ndarray] = []
            size = 0
            while begin + len(told) < len(texts) and size < PIECE:
                words = (texts[begin + len(told)] or "").split()
                size += len(texts[begin + len(told)] or "")
                told.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            place = np.array([self.words.get(w, -1) for w in number], np.int64)
            form = np.array([self.shapes.get(shape(w), -1) for w in number], np.int64)
            for row, numbers in enumerate(told, begin):
                if len(numbers):
                    out[row] = self._input(place[numbers], form[numbers], len(distinct(numbers)))
            begin += len(told)
        return out

    def _input(self, places: np.ndarray, forms: np.ndarray, distinct: int) -> np.ndarray:
        """The inputs of a text from the places of its words and of their shapes (-1: not in the model)."""
        out, n_words = np.zeros(2 * DIM + 4, np.float64), len(places)
        shapes, first, n = np.unique(forms[forms >= 0], return_index=True, return_counts=True)
        if len(shapes):
            # Sums are made in the order of the text.
            order = np.argsort(first)
            out[DIM : 2 * DIM] = n[order].astype(np.float64) @ self.vectors[shapes[order]] / n_words
        known = places[places >= 0]
        for begin in range(0, len(known), 65_536):
            out[:DIM] += self.vectors[known[begin : begin + 65_536]].sum(0)
        out[:DIM] /= max(1, len(known))
        lost = n_words - int(n.sum())
        out[2 * DIM :] = np.log1p(n_words), 1 - len(known) / n_words, distinct / n_words, 1 + lost / n_words
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.centre) / self.scale @ a + b) @ c + d

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(texts)) / self.temperature, -50, 50)))


def _index_vector(word: str) -> np.ndarray:
    pick = np.random.default_rng(zlib.crc32(word.encode("utf-8", "replace")))
    out = np.zeros(DIM, np.float32)
    out[pick.choice(DIM, NONZERO, replace=False)] = pick.choice([-1.0, 1.0], NONZERO)
    return out


def _word_vectors(texts: list[str]) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    counts: Counter = Counter()
    for t in texts:
        counts.update(t.split())
    kept = sorted((w for w, n in counts.items() if n >= LEAST_COUNT), key=lambda w: (-counts[w], w))[:VOCABULARY]
    words = {w: i for i, w in enumerate(kept)}
    shapes = {s: len(words) + i for i, s in enumerate(sorted({shape(w) for w in counts})[:VOCABULARY])}
    index = np.array([_index_vector(w) for w in [*words, *("\0" + s for s in shapes)]], np.float32).reshape(-1, DIM)
    total = np.zeros_like(index)
    place = {w: words.get(w, -1) for w in counts}
    form = {w: shapes.get(shape(w), -1) for w in counts}
    for t in texts:
        tokens = t.split()
        for begin in range(0, len(tokens), 50_000):
            part = tokens[begin : begin + 50_000]
            surface = np.fromiter((place[w] for w in part), np.int64, len(part))
            outer = np.fromiter((form[w] for w in part), np.int64, len(part))
            shown = np.where(surface >= 0, surface, outer)
            for target in (surface, outer):
                for step in range(1, WINDOW + 1):
                    for a, b in ((target[step:], shown[:-step]), (target[:-step], shown[step:])):
                        fine = (a >= 0) & (b >= 0)
                        a, b = a[fine], b[fine]
                        if len(a):
                            order = np.argsort(a, kind="stable")
                            a = a[order]
                            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                            total[a[starts]] += np.add.reduceat(index[b[order]], starts, axis=0)
    size = np.linalg.norm(total, axis=1, keepdims=True)
    return words, shapes, np.where(size > 0, total / np.maximum(size, 1e-9), index / np.sqrt(NONZERO)).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    pick = np.random.default_rng(SEED)
    p = [pick.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), pick.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
    step = 0
    for _ in range(EPOCHS):
        order = pick.permutation(len(x))
        for begin in range(0, len(x), 128):
            rows = order[begin : begin + 128]
            xb, yb, wb = x[rows], y[rows], weight[rows]
            h = np.tanh(xb @ p[0] + p[1])
            slope = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - yb) * wb / wb.sum()
            back = np.outer(slope, p[2]) * (1 - h * h)
            grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), h.T @ slope + 1e-4 * p[2], slope.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def _temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.average(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t), weights=weight) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_rows(texts: list[str | None], labels: list[int], shares: tuple[float, float] = (0.5, 0.5)) -> Model:
    """Fit on texts and 0/1 labels in the given order. ``shares``: how often 0 and 1 occur."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        constant = 0.5 if not labels else float((y.sum() + 1) / (len(y) + 2))
        return Model({}, {}, np.zeros((0, DIM), np.float32), np.zeros(0), np.ones(0), (), 1.0, constant)
    clean = [t or "" for t in texts]
    model = Model(*_word_vectors(clean), np.zeros(0), np.ones(0), (), 1.0)
    x = model.inputs(clean)
    weight = np.where(y > 0, shares[1] / max(1, (y > 0).sum()), shares[0] / max(1, (y == 0).sum()))
    weight /= weight.mean()
    aside = np.arange(len(y)) % 5 == 4
    fitted = ~aside if len(set(y[~aside])) == 2 else np.ones(len(y), bool)
    model.centre = x[fitted].mean(0)
    model.scale = x[fitted].std(0) + 1e-3
    model.layers = _train((x[fitted] - model.centre) / model.scale, y[fitted], weight[fitted])
    model.temperature = _temperature(model.logits(x[aside]), y[aside], weight[aside])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, train: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality). ``train`` says which ids may be learned from."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = (rows if train is None else rows.where(train)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    mixed = F.xxhash64("doc_id")
    picked = None
    for value in (0, 1):
        part = rows.where(F.col("quality") == value).orderBy(mixed, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 x per_class ids: a proven bound.
    ids = picked.select(F.col("doc_id").alias("picked_id"), F.col("quality").alias("picked_quality"))
    found = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).join(F.broadcast(ids), F.col("id") == F.col("picked_id"))
    sample = found.groupBy("id").agg(F.min("body").alias("body"), F.min("picked_quality").alias("quality")).collect()
    sample.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    shares = {int(r["quality"]): r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = sum(shares.values()) or 1
    return fit_rows([r.body for r in sample], [int(r.quality) for r in sample], (shares.get(0, 0) / whole, shares.get(1, 0) / whole))


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 for a text."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores([t if isinstance(t, str) else None for t in texts]))

    return of(text)


def keep_good(docs: DataFrame, labels: DataFrame, *, limit: float = 0.5, train: Column | None = None) -> DataFrame:
    """The documents whose score reaches ``limit``, with their columns as they are."""
    model = fit(docs, labels, train=train)
    return docs.where(score(model, F.col("text")) >= limit)


def op2_quality(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels, train=crc_mod(F.col("doc_id"), 3) != 1)
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Language identification: known words first, then shorter and shorter character n-grams.

Fitting. At most ``PER_LANGUAGE`` documents of each language, the first in the order of a hash of their id,
are brought to the driver (the documented bound of the sample). Words and character n-grams are counted per
language; a table keeps the smoothed log frequency of each in every language.

Scoring. A text is a bag of words of letters, lower-cased. A known word adds its log frequencies. An unseen word
adds the mean log frequency of its known n-grams of the greatest order that has any, from ``LONGEST`` down to 1.
The language with the greatest sum is predicted; the score is its posterior under equal priors.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was
learned; ties go to the first language in code point order; repeated rows have equal results; rows with a null
language teach nothing; empty tables give empty results.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import crc_mod

PER_LANGUAGE = 500
#: Parts of a language that are ranked apart.
SALTS = 64
WORDS = 100_000
GRAMS = 50_000
LONGEST = 5
SMOOTHING = 0.5
#: Unseen words that a task remembers, and distinct words of texts that are scored at once.
SEEN = 200_000
PIECE = 20_000
UNKNOWN = "und"
RESULT = "struct<lang_pred:string,score:double>"


def _classed(kinds: str) -> str:
    """A character class of all characters whose Unicode category begins with one of ``kinds``."""
    marks = [unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)]
    edges = np.flatnonzero(np.diff(np.array([False, *marks, False], np.int8))).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


#: A word is a letter and the letters and combining marks after it; numbers such as a half or a Roman ten are none.
LETTERS = re.compile(f"[{_classed('L')}][{_classed('LM')}]*")


#: ASCII but its letters becomes spaces; bytes of other characters stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, as LETTERS finds them; it is asked only for pieces that are not letters alone."""
    plain = text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).decode("utf-8", "surrogatepass")
    pieces = plain.split()
    if plain.isascii() or all(map(str.isalpha, pieces)):
        return pieces
    return [w for p in pieces for w in ((p,) if p.isalpha() else LETTERS.findall(p))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word; from 2 on its ends are marked."""
    w = word if n == 1 else f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _log_frequencies(counts: dict[str, Counter], languages: list[str], most: int, least: int) -> tuple[dict[str, int], np.ndarray]:
    whole: Counter = Counter()
    for c in counts.values():
        whole.update(c)
    kept = sorted((k for k, n in whole.items() if n >= least), key=lambda k: (-whole[k], k))[:most]
    table = np.array([[counts[lang][k] for lang in languages] for k in kept], np.float64).reshape(len(kept), len(languages))
    total = np.array([sum(counts[lang].values()) for lang in languages], np.float64)
    return {k: i for i, k in enumerate(kept)}, np.log((table + SMOOTHING) / (total + SMOOTHING * (len(kept) + 1)))


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray | None = None
    orders: list = field(default_factory=list)

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each unseen word: the mean of its known n-grams of the greatest order that has any."""
        out = np.zeros((len(words), len(self.languages)))
        left = list(range(len(words)))
        for n, places, table in self.orders:
            at, owners, starts, rest, get = [], [], [], [], places.get
            for k in left:
                found = [i for g in grams(words[k], n) if (i := get(g)) is not None]
                if found:
                    owners.append(k)
                    starts.append(len(at))
                    at += found
                else:
                    rest.append(k)
            if owners:
                sizes = np.diff(np.r_[starts, len(at)])
                out[owners] = np.add.reduceat(table[at], starts, axis=0) / sizes[:, None]
            left = rest
        return out

    def predict(self, text: str | None, cache: dict | None = None) -> tuple[str, float]:
        """Language and score of one text; ``cache`` is not needed any more."""
        return next(Scorer(self).predict([text]))


class Scorer:
    """Scores texts in turn; unseen words that it has met are not looked up by their n-grams again."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.places = dict(self.model.words)
        self.table = self.model.vectors

    def totals(self, bags: list[Counter]) -> np.ndarray:
        """The sums of log frequencies of bags of words, a row each."""
        if len(self.places) > len(self.model.words) + SEEN:
            self.forget()
        places = self.places
        fresh = list(dict.fromkeys(w for bag in bags for w in bag if w not in places))
        if fresh:
            places.update(zip(fresh, range(len(places), len(places) + len(fresh))))
            self.table = np.concatenate([self.table, self.model.unseen(fresh)])
        at = np.fromiter((places[w] for bag in bags for w in bag), np.int64)
        times = np.fromiter((n for bag in bags for n in bag.values()), np.float64)
        owner = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
        return np.stack([np.bincount(owner, times * column[at], len(bags)) for column in self.table.T], axis=1)

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text, some texts at a time."""
        bags: list[Counter] = []
        size = 0
        for text in texts:
            bags.append(Counter(words_of(text)) if text else Counter())
            size += len(bags[-1])
            if size >= PIECE or len(bags) >= PIECE:
                yield from self._named(bags)
                bags, size = [], 0
        yield from self._named(bags)

    def _named(self, bags: list[Counter]) -> Iterator[tuple[str, float]]:
        languages = self.model.languages
        totals = self.totals(bags) if bags and languages else np.zeros((len(bags), 1))
        best = totals.argmax(axis=1)
        scores = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1) if bags else ()
        for bag, k, score in zip(bags, best.tolist(), scores):
            yield (languages[k], float(score)) if bag and languages else (UNKNOWN, 0.0)


def fit_rows(rows: list[tuple[str, str | None]]) -> Model:
    """Fit on (language, text) pairs."""
    languages = sorted({lang for lang, _ in rows})
    words = {lang: Counter() for lang in languages}
    for lang, text in rows:
        words[lang].update(words_of(text or ""))
    model = Model(languages)
    model.words, model.vectors = _log_frequencies(words, languages, WORDS, 2)
    for n in range(LONGEST, 0, -1):
        counts = {lang: Counter() for lang in languages}
        for lang in languages:
            for w, times in words[lang].items():
                for g in grams(w, n):
                    counts[lang][g] += times
        model.orders.append((n, *_log_frequencies(counts, languages, GRAMS, 2 if n > 2 else 1)))
    return model


def fit(docs: DataFrame, *, train: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on ``docs`` (doc_id, text, lang); ``train`` says which rows may be learned from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known if train is None else known.where(train)
    ids = known.select(F.col("doc_id").alias("id"), F.col("lang").alias("named")).distinct()
    # First the least of each of SALTS parts of a language: no more than SALTS x per_language ids of it meet.
    order = [F.xxhash64("id"), F.col("id")]
    for keys in (["named", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS))], ["named"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ids = ids.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    # per_language ids for each language: a bound that does not grow with the rows.
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("named")))
    sample = texts.groupBy("id", "named").agg(F.min("text").alias("body")).collect()
    return fit_rows(sorted(((r.named, r.body) for r in sample), key=lambda r: (r[0], r[1] or "")))


def predict(model: Model, text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text."""

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            found = scorer.predict(t if isinstance(t, str) else None for t in texts)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return of(text)


def op3_language(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs, train=~held_out)
    found = docs.select("doc_id", held_out.alias("held_out"), predict(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")

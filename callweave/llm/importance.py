"""Target-distribution importance resampling with an Aho-Corasick dictionary.

Documents are drawn so that their words look like those of a target, the benchmark's texts. Features are runs of 1 to ``runs`` consecutive
words; a feature's bucket is the CRC-32 of its words joined by spaces, modulo ``buckets``. A bucket's gain is the logarithm of its share among
the target's features over its share among all documents' features; a document's weight is the sum of its features' gains. A Gumbel
number, made from a hash of the id, is added: the highest sums are a sample without replacement, in proportion to the exponential of the weights.

The dictionary holds the most frequent words of all texts, counted over whole tables, DICTIONARY at most. Each word stands between delimiters and carries its CRC
and its length as payload. Every task builds an automaton of it and scans texts, which it has lower-cased and whose delimiters it has made single
spaces; the automaton finds all words in one pass and emits their payloads. Where the lengths show a gap between two matches, words stand there that the
dictionary lacks; they are cut out and hashed, so any size of the dictionary gives the same result. The CRC of a run follows
from the payloads of its words: bytes appended to a message shift its CRC by a power of x, and the CRC of what is appended is added.

Two scans of the texts, one that counts buckets and one that scores; what goes between them is one row for each bucket. Counts are added up
within a task before they are shuffled, as are words. Ranks come from a range-partitioned sort (``ranks.ranked``), so no window covers all documents.

Defined cases: null texts and texts without words have no features, weight 0 and rank null; a null id is hashed as an empty text and comes after all other ids of
its score; repeated rows are scored and drawn each for itself; without documents the result is empty, without a target its counts are 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import CRC_TABLE_SQL, crc_sql, discard, need, written
from callweave.llm.ranks import ranked

BUCKETS = 10_000
RUNS = 1
SEED = 2024
#: Words of a document that may be drawn, and how many of 100 such documents are.
LEAST_WORDS, PER_CENT = 20, 10
#: Words in the automaton of a task.
DICTIONARY = 50_000
#: The longest word in the dictionary, in bytes.
LONGEST = 64

#: What a delimiter, or a byte of a word, becomes.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The generator of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(CLEAN).split()


def _shifts(bits: int = 32) -> np.ndarray:
    """For each k a matrix (as the images of 32 bits) that appends 2**k zero bytes to a message of given CRC."""
    one = np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)  # by one bit
    apply = lambda m, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1), m, np.uint32(0)), axis=1)
    for _ in range(3):
        one = apply(one, one)
    out = [one]
    while len(out) < bits:
        out.append(apply(out[-1], out[-1]))
    return np.stack(out)


SHIFTS = _shifts()


def appended(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of messages with others, of given lengths, appended."""
    out = crc.astype(np.uint32)
    places = np.arange(32, dtype=np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        some = (length >> k) & 1 == 1
        chosen = out[some]
        out[some] = np.bitwise_xor.reduce(np.where((chosen[:, None] >> places) & np.uint32(1), SHIFTS[k], np.uint32(0)), axis=1)
    return out ^ other.astype(np.uint32)


class Dictionary:
    """An automaton of words between delimiters; payloads are the CRC and, above 32 bits, the length."""

    def __init__(self, listed: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word in listed:
            self.automaton.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) | len(word) << 32)
        if listed:
            self.automaton.make_automaton()
        self.empty = not listed

    def payloads(self, text: str | None) -> np.ndarray:
        """The payloads of all words of a text, in order."""
        clean = b" ".join(words(text))
        if not clean:
            return np.zeros(0, np.uint64)
        # A byte is a character here, so places and lengths are in bytes.
        line = f" {clean.decode('latin-1')} "
        found = [] if self.empty else list(self.automaton.iter(line))
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        loads = np.fromiter((p for _, p in found), np.uint64, len(found))
        begins = ends - (loads >> np.uint64(32)).astype(np.int64)
        before, after = np.r_[0, ends], np.r_[begins, len(line)]
        gaps = np.flatnonzero(after - before > 1)
        if not len(gaps):
            return loads
        # Unknown words between the delimiter that closes a match and the one that opens the next.
        places, others = [], []
        for gap in gaps.tolist():
            missed = [zlib.crc32(w) | len(w) << 32 for w in clean[before[gap] : after[gap] - 2].split(b" ")]
            places += [gap] * len(missed)
            others += missed
        return np.insert(loads, places, np.array(others, np.uint64))


def features(loads: np.ndarray, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to ``runs`` words, composed of the payloads of neighbours."""
    crcs, lengths = loads.astype(np.uint32), (loads >> np.uint64(32)).astype(np.int64)
    out = [crcs % np.uint32(buckets)]
    whole = crcs
    spaced = appended(np.full(len(crcs), zlib.crc32(b" "), np.uint32), crcs, lengths) if runs > 1 else crcs
    for n in range(1, runs):
        if len(loads) <= n:
            break
        whole = appended(whole[:-1], spaced[n:], lengths[n:] + 1)
        out.append(whole % np.uint32(buckets))
    return np.concatenate(out).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word of ``text`` occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch["text"]:
                found.update(words(text))
            yield pd.DataFrame({"word": list(found), "n": np.fromiter(found.values(), np.int64, len(found))})

    return texts.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(texts: DataFrame, size: int = DICTIONARY) -> list[bytes]:
    """The most frequent words, at most ``size`` of at most LONGEST bytes.

    The least count that is taken is a power of two, found by a histogram of one row for each power, so that no more than ``size`` words leave the tasks.
    """
    short = written(word_counts(texts).where(F.length("word") <= LONGEST), "words")
    log2 = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int").alias("log2")
    left, least = size, None
    for power, n in sorted(((r["log2"], r["n"]) for r in short.groupBy(log2).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = 2**power
    found = [] if least is None else [bytes(r["word"]) for r in short.where(F.col("n") >= least).select("word").collect()]
    discard(short)
    return sorted(found)


def bucket_counts(texts: DataFrame, listed: list[bytes], runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; buckets without any are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Dictionary(listed)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(features(known.payloads(text), runs, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    return texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, n) of all documents and of the target."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    met = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    totals = met.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    double = lambda c: F.col(c).cast("double")
    share = ((double("t") + 1) * (double("all_s") + buckets)) / ((double("s") + 1) * (double("all_t") + buckets))
    return met.join(F.broadcast(totals)).select("bucket", F.floor(1000.0 * F.log(share)).alias("gain"))  # totals are one row


def scores(docs: DataFrame, listed: list[bytes], gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """``row`` (the input row), ``n_words``, ``n_features`` and ``weight``."""
    values = gain.astype(np.int64)

    @F.pandas_udf("struct<n_words:long,n_features:long,weight:long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Dictionary(listed)
        for batch in batches:
            out = np.zeros((len(batch), 3), np.int64)
            for i, text in enumerate(batch):
                loads = known.payloads(text)
                found = features(loads, runs, len(values))
                out[i] = len(loads), len(found), values[found].sum()
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, of(F.col("text")).alias("x")).select("row", "x.n_words", "x.n_features", "x.weight")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a Gumbel number g made from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(
    docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED,
    least: int = LEAST_WORDS, per_cent: int = PER_CENT, size: int = DICTIONARY, extra: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, extra) of every document; rank is null for those that are not drawn."""
    need(docs, ("doc_id", "text"))
    docs, target = docs.select("doc_id", "text", *extra), target.select("text")
    listed = dictionary(docs.select("text").unionByName(target), size)
    gained = gains(bucket_counts(docs, listed, runs, buckets), bucket_counts(target, listed, runs, buckets), buckets)
    # One number for each bucket.
    gain = np.zeros(buckets, np.int64)
    for r in gained.collect():
        gain[r["bucket"]] = r["gain"]
    scored = scores(docs, listed, gain, runs).withColumn("score", F.col("weight") + gumbel(F.col("row.doc_id"), seed))
    scored = written(scored.select("row.doc_id", *[f"row.{c}" for c in extra], "n_words", "n_features", "weight", "score"), "scores")
    fit = F.coalesce(F.col("n_words") >= least, F.lit(False))
    places = ranked(scored.where(fit).withColumn("all", F.lit(0)), ["all"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = F.col("place") < F.floor(F.col("total") * per_cent / 100)
    names = ["doc_id", "n_features", "weight", "score", *extra]
    placed = places.select(*names, F.when(drawn, F.col("place") + 1).cast("long").alias("rank"))
    out = written(placed.unionByName(scored.where(~fit).select(*names, F.lit(None).cast("long").alias("rank"))), "resampled")
    discard(scored)
    return out.select("doc_id", "n_features", "weight", "score", "rank", *extra)


def op13_importance(spark, folder: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return resampled(read("documents"), read("benchmark"))

SQL = rf"""
WITH crct AS (
  {CRC_TABLE_SQL}
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS id FROM documents
), target AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), own AS (
  SELECT id, unnest(w) AS word FROM docs
), theirs AS (
  SELECT unnest(w) AS word FROM target
), distinct_words AS (
  SELECT DISTINCT word FROM (SELECT word FROM own UNION ALL SELECT word FROM theirs)
), coded AS (
  SELECT word, {crc_sql("word")} % 10000 AS bucket FROM distinct_words, crct
), s AS (
  SELECT bucket, count(*) AS s FROM own JOIN coded USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM theirs JOIN coded USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM own)::DOUBLE AS all_s, (SELECT count(*) FROM theirs)::DOUBLE AS all_t
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket), totals
), weights AS (
  SELECT id, sum(gain) AS weight FROM own JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT d.id, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM docs d LEFT JOIN weights USING (id)
), summed AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM summed
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM placed
"""

"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

Documents with equal shingle sets are one class. Each class has a signature of SYMBOLS symbols of 16 bits, one
per MinHash function. Two sets of similarity s differ in about SYMBOLS x (1 - s) symbols; DISTANCE allows so many
that a pair at the similarity asked for exceeds it about once in a million. The signature is cut into
CHUNKS chunks with 2 x CHUNKS > DISTANCE, so by the pigeonhole principle two signatures within DISTANCE differ in at
most one symbol of some chunk. For every chunk the keys enumerate that one error: the chunk with each of its
symbols left out in turn. All pairs within DISTANCE therefore share a key.

Members of a key are connected by stars and by blocks (``components.linked``), never by a list of all pairs; star pairs within DISTANCE
and all pairs of a block are confirmed on the full shingle sets. Buckets and links are shuffled by hash, all steps are written to the shared
folder, and copies of one set are a single member.

Defined cases: null texts and texts without words have no shingles and stand alone; rows with equal id and text are
one document and have the same result, one row each; a null id ranks after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import written
from callweave.llm.components import linked
from callweave.llm.shingles import _mixed, minima, shingle_sets

SHINGLE = 5
SYMBOLS = 64
CHUNKS = 12
DISTANCE = 2 * CHUNKS - 1
#: Similarity is asked for as a fraction of whole numbers, so that it is exact.
PER_CENT = 85
NO_ID = 2**63 - 1
#: Rows taken at once inside a task.
ROWS = 64

#: Symbols of each chunk.
CUTS = [np.arange(SYMBOLS * i // CHUNKS, SYMBOLS * (i + 1) // CHUNKS) for i in range(CHUNKS)]


def signatures(keys: DataFrame) -> DataFrame:
    """(id, mark, n_shingles, digest, signature) of every document of ``keys`` (id, mark, text)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.iloc[begin : begin + ROWS]
                sets = shingle_sets(part["text"].tolist(), SHINGLE)
                full = [s for s in sets if len(s)]
                symbols = iter((minima(full, SYMBOLS) >> np.uint64(24)).astype(np.uint16))
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "mark": part["mark"].to_numpy(),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "signature": [next(symbols).tobytes() if len(s) else b"" for s in sets],
                    }
                )

    return keys.select("id", "mark", "text").mapInPandas(sign, "id long, mark long, n_shingles long, digest binary, signature binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(bucket, id): for each class one key per chunk and symbol left out."""

    def enumerate_errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.random.default_rng(3).integers(1, 2**63, (SYMBOLS, SYMBOLS), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            if not len(batch):
                continue
            symbols = np.frombuffer(b"".join(batch["signature"]), np.uint16).reshape(len(batch), SYMBOLS).astype(np.uint64) + np.uint64(1)
            ids = batch["node"].to_numpy()
            with np.errstate(over="ignore"):
                for chunk in CUTS:
                    for out in chunk:
                        rest = chunk[chunk != out]
                        key = _mixed(_mixed((symbols[:, rest] * salt[out, rest]).sum(axis=1)) + salt[out, out])
                        yield pd.DataFrame({"bucket": key.view(np.int64), "id": ids})

    return classes.select("node", "signature").mapInPandas(enumerate_errors, "bucket long, id long")


def _within_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures differ in at most DISTANCE symbols."""
    of = lambda side: classes.select(F.col("node").alias(side), F.col("signature").alias(f"s{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), SYMBOLS) for c in ("sa", "sb"))
                yield batch.loc[(x != y).sum(axis=1) <= DISTANCE, ["a", "b"]]

    return met.mapInPandas(near, "a long, b long")


def groups(keys: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """(id, mark, n_shingles, first_id, first_mark) for each row of ``keys`` (id, mark, text).

    ``first_id`` and ``first_mark`` name the least document of its component.
    """
    signed = written(signatures(keys), "signatures")
    full = signed.where(F.col("n_shingles") > 0)
    classes = full.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("signature").alias("signature"))
    # The number is fixed by writing it.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        # Numbers of a few documents as a rule: written, so that Spark knows their size and need not shuffle all texts to find theirs.
        firsts = written(classes.join(ids.withColumnRenamed("id", "node"), "node").select("node", "first.id", "first.mark"), "places")
        texts = keys.join(firsts, ["id", "mark"]).select("node", "text")

        def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for begin in range(0, len(batch), ROWS):
                    part = batch.iloc[begin : begin + ROWS]
                    sets = shingle_sets(part["text"].tolist(), SHINGLE)
                    yield pd.DataFrame({"id": part["node"].to_numpy(), "body": [s.tobytes() for s in sets]})

        # Rows with equal id and text make the same set more than once.
        return texts.mapInPandas(hashes, "id long, body binary").dropDuplicates(["id"])

    near = lambda pairs: _within_distance(pairs, classes)
    nodes = linked(chunk_keys(classes), sets_of, per_cent, near=near, purpose="near")
    placed = classes.select("digest", "first", "node").join(nodes.withColumnRenamed("id", "node"), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("first"))
    placed = placed.drop("first").join(firsts, "component").select("digest", "first")
    out = signed.join(placed, "digest", "left")
    return out.select(
        "id", "mark", "n_shingles", F.coalesce("first.id", "id").alias("first_id"), F.coalesce("first.mark", "mark").alias("first_mark")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """``row``, ``id`` (null: the greatest long), ``mark`` (hash of the text) and ``text``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"), F.col("text"))


def _firsts(keys: DataFrame, per_cent: int) -> DataFrame:
    """(id, mark) of the first document of each component."""
    return written(groups(keys, per_cent).where((F.col("id") == F.col("first_id")) & (F.col("mark") == F.col("first_mark"))).select("id", "mark"), "firsts")


def keep_one(docs: DataFrame, per_cent: int = 80) -> DataFrame:
    """The first document of each component, with its columns as they are."""
    keys = keyed(docs)
    return keys.join(_firsts(keys, per_cent), ["id", "mark"], "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_one_row(docs: DataFrame, per_cent: int = 80) -> DataFrame:
    """One row of each component: of rows with equal id and text, and of null ids with equal texts, a single one stays."""
    keys = keyed(docs)
    # A row per key and task goes into the one exchange, which serves the join as well.
    ones = keys.select("row", "id", "mark").dropDuplicates(["id", "mark"])
    return ones.join(_firsts(keys, per_cent), ["id", "mark"], "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_near_dups(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = groups(keyed(docs))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        null("id").alias("doc_id"), "n_shingles", null("first_id").alias("component_id"), (F.col("id") == F.col("first_id")).alias("kept")
    )


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN sides l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT l.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, l.doc_id = component_id AS kept FROM least l LEFT JOIN sizes USING (doc_id)
"""

"""Fuzzy line dedup: MinHash of character shingles, banding, exact verification, union-find.

Every distinct normalised line (as in ``units.normal``) has a MinHash signature of its character shingles, made in the
same pass that cuts the documents; a line that a task has signed is not signed again. BANDS bands of ROWS_PER_BAND values
bring together lines of similarity 0.8 with probability 0.997, more similar ones with more. The members of a band key are
connected by stars and by blocks (``components.linked``), never by a list of all pairs, and confirmed by the exact Jaccard similarity of
their shingle sets. Of each component the earliest line in the order (doc_id, text hash, place) stays.

What is shuffled are numbers, and the texts of lines that share a band key with another; shingles are made where lines are compared.
A line's number is half of its 128-bit digest. Should two lines have the same number, the one with the greater digest is like no other (at
10^12 lines, a given line has that chance of 5 in 10^8).

One changed character costs SHINGLE of a line's shingles, so a line of n characters and its copy share (n - 9) of (n + 1): one typo
is caught from 49 characters on, two from 94 at the latest.

Defined cases: lines without words always stay; a line shorter than a shingle is a shingle of its own; null and empty
texts have no lines; a null id ranks before all others; repeated rows (equal id and text) are one document; rows with
equal ids and different texts rank by the hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import discard, written
from callweave.llm.components import linked
from callweave.llm.shingles import _mixed, distinct
from callweave.llm.units import digest, kept_text, keyed, normal, remove_units, spans, with_pieces

SHINGLE = 5
BANDS = 15
ROWS_PER_BAND = 5
PER_CENT = 80
#: Lines are compared if their MinHash values agree in so many places fewer than expected at the similarity asked for. Of 75 values, 60 are expected
#: at 0.8, and fewer than 45 occur about once in 50,000 pairs.
LESS = 15
#: Lines are many small rows, so batches are smaller than elsewhere. Rows of both kinds are written as they come, without a sort by kind.
STEP = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.maxConcurrentOutputFileWriters": "4"}
#: Characters signed at once inside a task.
PIECE = 500_000
#: Digests that a task remembers as signed.
SIGNED = 200_000

_rng = np.random.default_rng(11)
FLIPS = _rng.integers(1, 2**32, BANDS * ROWS_PER_BAND, dtype=np.uint32)
FACTORS = _rng.integers(1, 2**32, BANDS * ROWS_PER_BAND, dtype=np.uint32) | np.uint32(1)
SALTS = _rng.integers(1, 2**63, (BANDS, ROWS_PER_BAND), dtype=np.uint64) | np.uint64(1)
POWERS = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all (non-empty) lines in turn, and where each line's begin."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    with np.errstate(over="ignore"):
        total = points * POWERS[0]
        for i in range(1, SHINGLE):
            total[:-i] += points[i:] * POWERS[i]
        # A line's last places start no whole shingle, but a line that is too short keeps its first.
        whole = np.ones(len(points), bool)
        for i in range(1, SHINGLE):
            whole[ends[sizes >= i] - i] = False
        short = np.flatnonzero(sizes < SHINGLE)
        whole[begins[short]] = True
        total[begins[short]] = 0
        for i in range(SHINGLE - 1):
            own = begins[short[sizes[short] > i]]
            total[own] += points[own + i] * POWERS[i]
        counts = np.maximum(sizes - SHINGLE + 1, 1)
        return _mixed(total[whole]), np.cumsum(counts) - counts


def _least(lines: list[str]) -> Iterator[np.ndarray]:
    """The MinHash values of non-empty lines, one row each, some lines at a time."""
    begin = 0
    while begin < len(lines):
        end, size = begin, 0
        while end < len(lines) and (end == begin or size + len(lines[end]) <= PIECE):
            size += len(lines[end])
            end += 1
        hashes, starts = shingle_hashes(lines[begin:end])
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        work, out = np.empty_like(short), np.empty((len(FLIPS), len(starts)), np.uint32)
        with np.errstate(over="ignore"):
            for k, (f, m) in enumerate(zip(FLIPS, FACTORS)):
                np.multiply(np.bitwise_xor(short, f, out=work), m, out=work)
                np.minimum.reduceat(work, starts, out=out[k])
        yield np.ascontiguousarray(out.T)
        begin = end


def band_keys(lines: list[str]) -> np.ndarray:
    """The band keys of non-empty lines, a row of BANDS for each."""
    out = [np.zeros((0, BANDS), np.int64)]
    for least in _least(lines):
        with np.errstate(over="ignore"):
            values = least.astype(np.uint64).reshape(-1, BANDS, ROWS_PER_BAND) + np.uint64(1)
            out.append(_mixed((values * SALTS).sum(axis=2) + SALTS[:, 0]).view(np.int64))
    return np.concatenate(out)


def signatures(lines: list[str]) -> list[bytes]:
    """A byte of every MinHash value of non-empty lines."""
    return [row.tobytes() for least in _least(lines) for row in (least >> np.uint32(12)).astype(np.uint8)]


def signed_units(keys: DataFrame, unit: str = "line") -> DataFrame:
    """Units (id, mark, place, start, end, digest, node; kind 0), and (node, bands; kind 1) of lines that a task has first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda digests: np.frombuffer(b"".join(digests), np.int64)[::2]
        names = ["id", "mark", "place", "start", "end", "digest", "node", "bands", "kind"]

        def table(kind: int, node: np.ndarray, bands=None, digests=None, **known) -> pa.RecordBatch:
            rest = {"digest": pa.array(digests or [None] * len(node), pa.binary()), "bands": pa.array([None] * len(node) if bands is None else list(bands), pa.list_(pa.int64()))}
            zeros = np.zeros(len(node), np.int64)
            columns = {"node": node, "kind": zeros + kind, **known, **rest}
            types = {c: pa.int64() if c in ("id", "mark", "node") else pa.int32() for c in names if c not in rest}
            return pa.RecordBatch.from_arrays([columns[c] if c in rest else pa.array(columns.get(c, zeros), types[c]) for c in names], names)

        signed: set[bytes] = set()
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            digests: list[bytes] = []
            fresh: dict[bytes, str] = {}
            if len(signed) > SIGNED:
                signed = set()
            for row, text in enumerate(batch["text"].to_pylist()):
                for place, (start, end) in enumerate(spans(text, unit)):
                    words = normal(text[start:end])
                    if words:
                        d = digest(words)
                        rows.append((row, place, start, end))
                        digests.append(d)
                        if d not in signed:
                            signed.add(d)
                            fresh[d] = words
            keys, marks = batch["id"].to_numpy(), batch["mark"].to_numpy()
            for begin in range(0, len(rows), 20_000):
                row, place, start, end = np.array(rows[begin : begin + 20_000]).T
                some = digests[begin : begin + 20_000]
                yield table(0, number(some), digests=some, id=keys[row], mark=marks[row], place=place, start=start, end=end)
            made, bands = number(fresh), band_keys(list(fresh.values()))
            for begin in range(0, len(made), 20_000):
                yield table(1, made[begin : begin + 20_000], bands[begin : begin + 20_000])

    schema = "id long, mark long, place int, start int, end int, digest binary, node long, bands array<long>, kind int"
    return keys.select("id", "mark", "text").mapInArrow(cut, schema)


def _band_members(signed: DataFrame) -> DataFrame:
    return signed.where("kind = 1").select(F.explode("bands").alias("bucket"), F.col("node").alias("id"))


def shingle_sets(bodies: Sequence[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of normalised lines in UTF-8."""
    out: list[np.ndarray] = []
    begin = 0
    while begin < len(bodies):
        end, size = begin, 0
        while end < len(bodies) and (end == begin or size + len(bodies[end]) <= PIECE):
            size += len(bodies[end])
            end += 1
        hashes, starts = shingle_hashes([b.decode("utf-8", "surrogatepass") for b in bodies[begin:end]])
        out += [distinct(hashes[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)])]
        begin = end
    return out


def later_lines(keys: DataFrame, unit: str = "line", per_cent: int = PER_CENT) -> DataFrame:
    """The units (id, mark, start, end, later) that are like an earlier one; all of them are later."""
    signed = written(signed_units(keys, unit), "units", STEP, "kind")
    units = signed.where("kind = 0").drop("kind", "bands")
    rank = F.struct("id", "mark", "place")
    lines = units.groupBy("digest").agg(
        F.min(F.struct("id", "mark", "place", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n"), F.min("node").alias("node")
    )
    lines = written(lines, "lines")

    def bodies_of(ids: DataFrame) -> DataFrame:
        found = lines.join(ids.withColumnRenamed("id", "node"), "node").groupBy("node").agg(F.min(F.struct("digest", "first")).alias("x"))
        places = found.select("node", *[f"x.first.{c}" for c in ("id", "mark", "start", "end")])
        # A document's lines go to its text in one row; its own length bounds them.
        listed = places.groupBy("id", "mark").agg(F.collect_list(F.struct("node", "start", "end")).alias("lines"))
        # Repeated rows go as documents: their lines would need an exchange of their own.
        texts = keys.select("id", "mark", "text").repartition("id", "mark").dropDuplicates(["id", "mark"]).join(listed, ["id", "mark"])
        raw = texts.select("text", "lines.node", "lines.start", "lines.end")

        def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    lines = [normal(text[a:b]) for text, start, end in zip(batch["text"], batch["start"], batch["end"]) for a, b in zip(start.tolist(), end.tolist())]
                    body = [t.encode("utf-8", "surrogatepass") for t in lines]
                    yield pd.DataFrame({"id": np.concatenate(batch["node"].tolist()), "body": body, "sig": signatures(lines)})

        return raw.mapInPandas(bodies, "id long, body binary, sig binary")

    agree = max(0, BANDS * ROWS_PER_BAND * per_cent // 100 - LESS)
    nodes = linked(_band_members(signed), bodies_of, per_cent, sets=shingle_sets, agree=agree, stars=1, purpose="lines", met=lambda: discard(signed, kind="kind=1"))
    met = lines.join(nodes.withColumnRenamed("id", "node"), "node")
    # Of lines with one number the least digest is the one that was compared.
    own = met.groupBy("node").agg(F.min("digest").alias("digest"))
    linked_lines = written(met.select("digest", "first", "component").join(own.select("digest"), "digest", "left_semi"), "linked")
    firsts = linked_lines.groupBy("component").agg(F.min("first").alias("least"))
    # Lines that stay everywhere are left out: they occur once and are like no other.
    some = linked_lines.join(firsts, "component").select("digest", F.col("least").alias("first"))
    alone = lines.where(F.col("n") > 1).select("digest", "first").join(linked_lines.select("digest"), "digest", "left_anti")
    found = units.select("id", "mark", "place", "start", "end", "digest").join(some.unionByName(alone), "digest")
    gone = found.where(rank != F.struct("first.id", "first.mark", "first.place"))
    return gone.select("id", "mark", "start", "end", F.lit(True).alias("later"))


def dedup(docs: DataFrame, unit: str = "line", per_cent: int = PER_CENT) -> DataFrame:
    """``row`` (the input row) and ``result``: kept text, sizes in bytes, and removed spans in code points."""
    keys = keyed(docs)
    return remove_units(keys, later_lines(keys, unit, per_cent))


def dedup_texts(docs: DataFrame, unit: str = "line") -> DataFrame:
    """The documents with their texts cut, other columns as they are.

    ``n_chars``, where there is one, follows the text. Documents go if cutting leaves nothing but white space.
    """
    keys = keyed(docs)
    cut = with_pieces(keys, later_lines(keys, unit))
    changed = F.col("pieces").isNotNull()
    cut = cut.select("row", changed.alias("changed"), kept_text(F.when(changed, F.col("row.text")), F.col("pieces")).alias("kept"))
    changed = F.col("changed")
    left = cut.where(~changed | (F.trim(F.translate("kept", "\t\n\x0b\x0c\r", "     ")) != ""))
    types = dict(docs.dtypes)
    values = {"text": F.col("kept"), "n_chars": F.length("kept").cast(types.get("n_chars", "long"))}
    own = lambda c: F.col("row").getField(c)
    return left.select(*[(F.when(changed, values[c]).otherwise(own(c)) if c in values else own(c)).alias(c) for c in docs.columns])


def op5_fuzzy_lines(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    pieces = F.transform("result.removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return dedup(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.col(f"result.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")],
        F.array_join(pieces, " ").alias("removed"),
    )


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS place,
         len(string_split(text, chr(10))) AS n FROM docs
), units AS (
  SELECT doc_id, place, CASE WHEN place < n THEN unit || chr(10) ELSE unit END AS unit,
         trim(regexp_replace(lower(unit), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS words FROM cut
), lines AS (
  SELECT words, row_number() OVER (ORDER BY words) AS node, min(row(doc_id, place)) AS first FROM units WHERE words <> '' GROUP BY words
), shingles AS (
  SELECT DISTINCT node, unnest(CASE WHEN length(words) < 5 THEN [words] ELSE [words[i:i + 4] FOR i IN generate_series(1, length(words) - 4)] END) AS s FROM lines
), sizes AS (
  SELECT node, count(*) AS n FROM shingles GROUP BY node
), shared AS (
  SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.node < b.node GROUP BY a.node, b.node
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.node = s.a JOIN sizes y ON y.node = s.b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, other) AS (
  SELECT node, node FROM lines UNION SELECT r.node, l.b FROM reach r JOIN sides l ON l.a = r.other
), firsts AS (
  SELECT r.node, min(l.first) AS first FROM reach r JOIN lines l ON l.node = r.other GROUP BY r.node
), ranked AS (
  SELECT u.doc_id, u.place, u.unit, u.words <> '' AND row(u.doc_id, u.place) <> f.first AS gone,
         coalesce(sum(length(u.unit)) OVER (PARTITION BY u.doc_id ORDER BY u.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM units u LEFT JOIN lines l ON l.words = u.words LEFT JOIN firsts f ON f.node = l.node
), fixed AS (
  SELECT doc_id, place, unit, coalesce(gone, false) AS gone, start FROM ranked
), edges AS (
  SELECT *, coalesce(lag(gone) OVER w, false) AS before FROM fixed WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), runs AS (
  SELECT *, sum(CASE WHEN gone AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM edges
), removed AS (
  SELECT doc_id, run, min(start) AS a, max(start + length(unit)) AS b FROM runs WHERE gone GROUP BY doc_id, run
), listed AS (
  SELECT doc_id, string_agg(a::BIGINT::VARCHAR || '-' || b::BIGINT::VARCHAR, ' ' ORDER BY a) AS removed, count(*) AS n_spans FROM removed GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(strlen(unit)) AS n_bytes, coalesce(sum(strlen(unit)) FILTER (gone), 0) AS n_removed,
         sha256(coalesce(string_agg(unit, '' ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM fixed GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::INTEGER AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(removed, '') AS removed
FROM docs d LEFT JOIN sums USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

"""Repeated strings of SPAN bytes by a difference cover.

A suffix array sorted to a depth of SPAN bytes, made only where it can matter:

1. Sample. D is a perfect difference cover modulo 133: for any two places i and j some shift d below 133 puts both i + d and j + d
   into the sample. If the SPAN bytes at i and j are equal, so are the 68 bytes at i + d and j + d. Every sampled place gets the name of
   its 68 bytes (a hash), names are dealt out and sorted, and neighbours in the order are compared. Places whose name is unique
   belong to no repeated string. The sample is 12 of 133 places.
2. Recurse on what is left: stretches of text within reach of a sampled place whose name repeats (132 bytes before it to SPAN after it).
3. Merge the remaining suffixes. Every place of the stretches gets the name of its SPAN bytes (80 bits), names are dealt out by parts of
   their range and sorted, and neighbours are compared: equal ones are the places that start a repeated string.
4. The strings that start there cover the bytes that go.

Names replace ranks, since only equality to a depth of SPAN is asked for, not the order of suffixes; so no global numbering is needed.
A name that repeats within a batch is sent once, so that a passage in a third of all documents is one row per batch. Sorting spills; the
comparison streams over sorted rows and keeps one row. Texts that occur more than once are found by their hash: all their bytes go
(if there are SPAN), and only one copy takes part in the rest. Matches never cross documents.

Defined cases: null and empty texts have no bytes; texts below SPAN bytes stay; rows with equal id and text are one document; a null id is
an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import discard, written

SPAN = 200
MODULUS = 133
#: A perfect difference set modulo 133.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
WINDOW = SPAN - MODULUS + 1
#: Bytes hashed at once, and places whose names are compared before they are sent.
PIECE = 1_000_000
PLACES = 3_000_000
#: Bytes of stretches to a part of the range of names: what one group compares.
PART_BYTES = 4_000_000

_rng = np.random.default_rng(2024)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
LEVELS = _rng.integers(1, 2**63, (16, 2), dtype=np.uint64) | np.uint64(1)
SAMPLED = np.zeros(MODULUS, bool)
SAMPLED[list(COVER)] = True


def names(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit names of the ``width`` bytes from each place that has so many behind it."""
    out, size, level = BYTE[buf], 1, 0
    with np.errstate(over="ignore"):
        while size < width:
            step = min(size, width - size)
            a, b = LEVELS[level]
            out = out[: len(out) - step] * a + out[step:] * b
            out ^= out >> np.uint64(31)
            size, level = size + step, level + 1
    return out


def _pieces(raw: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, begins and bytes of consecutive texts of at least ``least`` bytes, about PIECE bytes at once."""
    part: list[int] = []
    size = 0
    for i, r in enumerate(raw):
        if len(r) >= least:
            part.append(i)
            size += len(r)
        if part and (size >= PIECE or i == len(raw) - 1):
            sizes = np.array([len(raw[j]) for j in part])
            yield np.array(part), np.cumsum(sizes) - sizes, np.frombuffer(b"".join([raw[j] for j in part]), np.uint8)
            part, size = [], 0
    if part:
        sizes = np.array([len(raw[j]) for j in part])
        yield np.array(part), np.cumsum(sizes) - sizes, np.frombuffer(b"".join([raw[j] for j in part]), np.uint8)


def _bytes(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def _sampled(keys: DataFrame) -> DataFrame:
    """(name, key, place, sure): sampled names, once per batch; sure places repeat within the batch."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, owner, where = [], [], []
            for part, begins, buf in _pieces(_bytes(batch["text"]), SPAN):
                every = names(buf, WINDOW)
                of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(buf)]))[: len(every)]
                place = np.arange(len(every)) - begins[of]
                size = np.diff(np.r_[begins, len(buf)])[of]
                at = np.flatnonzero(SAMPLED[place % MODULUS] & (place + WINDOW <= size))
                found.append(every[at])
                owner.append(part[of[at]])
                where.append(place[at])
            if not found:
                continue
            name, of, place = np.concatenate(found), np.concatenate(owner), np.concatenate(where)
            _, first, inverse, counts = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            repeats = counts[inverse] > 1
            lead = np.zeros(len(name), bool)
            lead[first] = True
            send = lead | repeats
            yield pd.DataFrame(
                {
                    # Places that are sure only need to arrive: their names are spread and not compared.
                    "name": name[send].view(np.int64),
                    "key": batch["key"].to_numpy()[of[send]],
                    "place": place[send].astype(np.int32),
                    "sure": np.where(repeats[send], np.where(lead[send], 2, 1), 0).astype(np.int8),
                }
            )

    return keys.select("key", "text").mapInPandas(sample, "name long, key long, place int, sure byte")


def _repeated(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows that equal a neighbour in all of ``by`` (sure 0 or 2: one of a batch) or are sure themselves (1 or 2)."""
    spread = rows.repartition(by[0]).sortWithinPartitions(*by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.select(*keep).schema)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A row is held back until the row after it is known.
        held: pd.DataFrame | None = None
        was = False  # whether the held row equals the one before it
        for batch in batches:
            if not len(batch):
                continue
            sent = batch["sure"].to_numpy() != 1
            alone = batch[~sent]
            if len(alone):
                yield alone[keep]
            part = batch[sent]
            if not len(part):
                continue
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            same = np.ones(len(part) - 1, bool)
            for c in by:
                v = part[c].to_numpy()
                same &= v[1:] == v[:-1]
            hit = np.r_[was, same] | np.r_[same, False] | (part["sure"].to_numpy() == 2)
            yield part[keep][hit][:-1] if hit[-1] else part[keep][hit]
            held, was = part.iloc[-1:], bool(len(same) and same[-1]) or (was if not len(same) else False)
        if held is not None and (was or held["sure"].iloc[0] == 2):
            yield held[keep]

    return spread.mapInPandas(compare, schema)


def _stretches(texts: DataFrame) -> DataFrame:
    """(key, start, body, near): stretches of a text around its ``places``; near is the least name in it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, raw, found in zip(batch["key"], _bytes(batch["text"]), batch["found"]):
                pairs = sorted((f["place"], f["name"]) for f in found)
                start = end = near = None
                for place, name in pairs:
                    a, b = max(0, place - MODULUS + 1), min(len(raw), place + SPAN)
                    if end is not None and a <= end:
                        end, near = max(end, b), min(near, name)
                        continue
                    if end is not None and end - start >= SPAN:
                        out.append((key, start, raw[start:end], near))
                    start, end, near = a, b, name
                if end is not None and end - start >= SPAN:
                    out.append((key, start, raw[start:end], near))
            yield pd.DataFrame(out, columns=["key", "start", "body", "near"])

    return texts.select("key", "text", "found").mapInPandas(cut, "key long, start int, body binary, near long")


def _runs(at: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lengths of runs of consecutive sorted numbers on one line."""
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(lines) != 0)])
    return at[first], np.diff(np.r_[first, len(at)])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses where the upper ones are alike."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


#: Kinds of rows: the stretches of a batch, its places that are known to repeat, and names to be compared.
HEADER, SURE, NAMES = 0, 1, 2
ROW = "part int, batch long, kind int, n int, body binary"


def _all_places(stretches: DataFrame, parts: int) -> DataFrame:
    """Names of SPAN bytes, once per batch, packed by the part of the names' range (see ROW).

    Places of a batch are numbered through; its header says which stretch a number is in.
    """

    def flush(keys: np.ndarray, starts: np.ndarray, raw: list[bytes]) -> Iterator[pd.DataFrame]:
        found, more = [], []
        counts = np.array([len(r) - SPAN + 1 for r in raw])
        for _, begins, buf in _pieces(raw, SPAN):
            every = names(buf, SPAN)
            sizes = np.diff(np.r_[begins, len(buf)])
            of = np.repeat(np.arange(len(begins)), sizes)[: len(every)]
            at = np.flatnonzero(np.arange(len(every)) - begins[of] + SPAN <= sizes[of])
            found.append(every[at])
            # 16 more bits, from bytes named at another width.
            more.append((names(buf, SPAN - 1)[at + 1] >> np.uint64(7)).astype(np.uint16))
        name, extra = np.concatenate(found), np.concatenate(more)
        batch = int.from_bytes(hashlib.blake2b(keys.tobytes() + starts.tobytes(), digest_size=8).digest(), "little", signed=True)
        header = np.concatenate([keys, starts, counts]).astype(np.int64).tobytes()
        away = -1 - (batch & 0xFFFF)
        out = [(away, batch, HEADER, len(keys), header)]
        unique, first, inverse, times = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        repeats = np.flatnonzero((times > 1)[inverse])
        del inverse
        if len(repeats):
            heads, lengths = _runs(repeats, np.zeros(len(repeats)))
            out.append((away, batch, SURE, len(heads), np.concatenate([heads, lengths]).astype(np.int64).tobytes()))
        part = ((unique >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1))
        for i in range(parts):
            low, high = edges[i], edges[i + 1]
            if high > low:
                own = unique[low:high]
                body = _planes(np.diff(own, prepend=np.uint64(0))) + _planes(extra[first[low:high]]) + _planes(first[low:high].astype(np.uint32))
                out.append((i, batch, NAMES, high - low, body))
        yield pd.DataFrame(out, columns=["part", "batch", "kind", "n", "body"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, starts, raw, size = [], [], [], 0
        for batch in batches:
            for key, start, body in zip(batch["key"], batch["start"], batch["body"]):
                keys.append(key)
                starts.append(start)
                raw.append(bytes(body))
                size += len(body)
                if size >= PLACES:
                    yield from flush(np.array(keys), np.array(starts), raw)
                    keys, starts, raw, size = [], [], [], 0
        if raw:
            yield from flush(np.array(keys), np.array(starts), raw)

    return stretches.select("key", "start", "body").mapInPandas(each, ROW)


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Places of a part whose name another batch has too; other rows as they are."""
    group = group.sort_values(["batch", "kind"], kind="stable")
    packed = group[group["kind"] == NAMES]
    out = group[group["kind"] != NAMES]
    if len(packed) < 2:
        return out
    found, extras, numbers = [], [], []
    for n, body in zip(packed["n"].tolist(), packed["body"]):
        found.append(np.cumsum(_from_planes(body[: 8 * n], np.uint64, n), dtype=np.uint64))
        extras.append(_from_planes(body[8 * n : 10 * n], np.uint16, n))
        numbers.append(_from_planes(body[10 * n :], np.uint32, n))
    of = np.repeat(np.arange(len(packed)), packed["n"].to_numpy())
    name, extra, number = np.concatenate(found), np.concatenate(extras), np.concatenate(numbers)
    del found, extras, numbers
    order = np.lexsort((extra, name))
    same = (name[order][1:] == name[order][:-1]) & (extra[order][1:] == extra[order][:-1])
    hit = order[np.r_[same, False] | np.r_[False, same]]
    rows = []
    for i, batch in enumerate(packed["batch"].tolist()):
        own = np.sort(number[hit[of[hit] == i]])
        if len(own):
            heads, lengths = _runs(own.astype(np.int64), np.zeros(len(own)))
            rows.append((0, batch, SURE, len(heads), np.concatenate([heads, lengths]).astype(np.int64).tobytes()))
    return pd.concat([out, pd.DataFrame(rows, columns=list(group.columns))])


def _decode(group: pd.DataFrame) -> pd.DataFrame:
    """(key, place, n): runs of places that start a repeated string, from the header and the runs of a batch."""
    head = group[group["kind"] == HEADER].iloc[0]
    n = int(head["n"])
    keys, starts, counts = np.frombuffer(head["body"], np.int64).reshape(3, n)
    ends = np.cumsum(counts)
    marked = np.zeros(int(ends[-1]) + 1, np.int8)
    for size, body in zip(group.loc[group["kind"] == SURE, "n"].tolist(), group.loc[group["kind"] == SURE, "body"]):
        heads, lengths = np.frombuffer(body, np.int64).reshape(2, size)
        places = np.repeat(heads - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(int(lengths.sum()))
        marked[places] = 1
    at = np.flatnonzero(marked)
    line = np.searchsorted(ends, at, side="right")
    first, size = _runs(at, line) if len(at) else (at, at)
    of = np.searchsorted(ends, first, side="right")
    return pd.DataFrame({"key": keys[of], "place": (first - (ends - counts)[of] + starts[of]).astype(np.int32), "n": size.astype(np.int32)})


def _covered(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans covered by strings of SPAN bytes at runs (first, n) of starts."""
    merged: list[list[int]] = []
    for first, n in sorted(starts):
        end = first + n - 1 + SPAN
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([first, end])
    return [(a, b) for a, b in merged]


RESULT = "struct<kept:binary,n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,removed:array<struct<start:int,end:int>>>"


def _without(text: Column, whole: Column, found: Column) -> Column:
    @F.pandas_udf(RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, wholes, lists in batches:
            out = []
            for raw, everything, runs in zip(_bytes(texts), wholes, lists):
                spans = [(0, len(raw))] if everything and len(raw) >= SPAN else _covered([(r["place"], r["n"]) for r in runs]) if runs is not None else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                out.append((rest, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return of(text, whole, found)


def dedup(docs: DataFrame) -> DataFrame:
    """``row`` (the input row) and ``result``: kept bytes, sizes, hash, and removed spans as byte offsets."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row, F.xxhash64(F.col("doc_id").cast("string"), text).alias("key"), text.alias("text"))
    facts = rows.select("key", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(9), "text").alias("two"))
    copies = facts.groupBy("one", "two").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last")
    copied = written(facts.join(copies, ["one", "two"]).select("key", (F.col("key") == F.col("first")).alias("stands")).distinct(), "copies")

    flagged = _repeated(_sampled(rows), ["name"], ["name", "key", "place"]).distinct()
    places = flagged.groupBy("key").agg(F.collect_list(F.struct("place", "name")).alias("found"))
    places = written(places.join(copied.where(~F.col("stands")), "key", "left_anti"), "sample")
    texts = rows.select("key", "text").join(places, "key")
    # Repeated rows make a stretch more than once.
    stretches = written(_stretches(texts).dropDuplicates(["key", "start"]), "stretches")
    total = stretches.agg(F.sum(F.length("body"))).first()[0] or 0
    # Stretches with equal least names are mostly copies of each other: together they send each name once. Sorted, they make
    # the same batches whenever a task is run again.
    ordered = stretches.repartition("near").sortWithinPartitions("near", "key", "start")
    packed = _all_places(ordered, 1 + total // PART_BYTES)
    compared = packed.groupBy("part").applyInPandas(_compare, ROW)
    starts = compared.groupBy("batch").applyInPandas(_decode, "key long, place int, n int")
    # The stretches are read until here.
    runs = written(starts.groupBy("key").agg(F.collect_list(F.struct("place", "n")).alias("runs")), "runs")
    discard(places, stretches)
    marks = runs.join(copied.select("key", F.lit(True).alias("whole")), "key", "full")
    met = rows.join(marks, "key", "left")
    return met.select("row", _without(F.col("text"), F.coalesce("whole", F.lit(False)), F.col("runs")).alias("result"))


def op6_suffixes(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"result.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])

"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK walk copies characters of a string to its output and moves on or waits by a random bit of (step, character).
Strings at a small edit distance become strings at a small Hamming distance, so equality on sampled places of the output is
likely; REPEATS samples of PLACES places each bring the recall up. Windows have the size of the benchmark items' length
class. Every window of an item that starts at a word is in the index; of a document every window that starts at each
``stride``-th word is looked up. A passage holds several such windows, each of them sure to be indexed at some offset of the
item, so the alignment of both is known and the whole item is verified there: Myers' bit-parallel algorithm gives the exact
edit distance of the item to the best substring.

The walk needs windows, of which short items and items in text without spaces have few or none, and it finds by chance. So every
item is also cut into one piece more than it may have edits. The pieces go in pairs; k edits cannot break each pair twice and a last
single piece once, so a piece stands unchanged beside its other half with at most one edit (or is the single one). Pieces are looked
up at every character of a document, and such places are verified as well: no passage within the allowed edits is missed. One
case is left to the walk: an item of several words under SHORT characters inside an unbroken run of characters.

The index of a block of at most BLOCK items goes to the tasks; more items make more blocks, all applied in the same scan
of the documents. There is no shuffle.

Defined cases: null and empty texts match nothing, null and blank items are left out; case is ignored and every white-space
character counts as a space; repeated items and rows give repeated results; an empty table on either side gives no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 5_000
#: Window length and the words from one looked-up window to the next.
CLASSES = ((48, 2), (24, 2), (12, 1), (6, 1), (1, 1))
REPEATS = 20
PLACES = 13
#: Edits allowed, as a share of the item's length.
EDITS = 0.1
BITS = 16
#: Longest piece that is looked up, and the bits of its hash that are tried first.
WIDEST = 16
PIECE_BITS = 20
#: Items of several words and fewer characters are not looked up by pieces where no space is near.
SHORT = 12
SEED = 5
RESULT = "array<struct<item_id:long,distance:int,start:int,end:int>>"
OTHER_SPACE = re.compile(r"[^\S ]")


def normal(text: str) -> str:
    """The text with each character lower-cased (where that keeps one character) and white space as spaces."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return OTHER_SPACE.sub(" ", low)


def _points(text: str) -> np.ndarray:
    """Characters as bytes; 0 is kept for what lies beyond a window."""
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((wide ^ (wide >> np.uint32(8))) % np.uint32(255)).astype(np.uint8) + np.uint8(1)


def _word_starts(points: np.ndarray, space: int) -> np.ndarray:
    gap = points == space
    return np.flatnonzero(~gap & np.r_[True, gap[:-1]])


SPACE = int(_points(" ")[0])
POWERS = np.random.default_rng(SEED).integers(1, 2**63, WIDEST, dtype=np.uint64) | np.uint64(1)


class Embedding:
    """The random walk for windows of ``size`` characters, hashed on its sampled places."""

    def __init__(self, size: int, seed: int = SEED):
        pick = np.random.default_rng(seed)
        self.size, self.steps = size, 3 * size
        # How far the walk moves; beyond the window (character 0) it stays.
        self.moves = pick.integers(0, 2, (self.steps, 256), dtype=np.uint8)
        self.moves[:, 0] = 0
        places = min(PLACES, self.steps)
        self.sampled: list[list[tuple[int, np.uint64]]] = [[] for _ in range(self.steps)]
        for repeat in range(REPEATS):
            # Early places are passed by every walk before the window ends.
            for place in pick.choice(min(self.steps, 2 * size), min(places, 2 * size), replace=False):
                self.sampled[int(place)].append((repeat, np.uint64(int(pick.integers(1, 2**63)) | 1)))
        self.last = max(i for i, s in enumerate(self.sampled) if s)

    def hashes(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """REPEATS hashes of the windows of ``points`` (with ``size`` zeros behind) at ``starts``."""
        out = np.zeros((REPEATS, len(starts)), np.uint64)
        with np.errstate(over="ignore"):
            for begin in range(0, len(starts), 16_384):
                first = starts[begin : begin + 16_384].astype(np.int64)
                end = first + self.size
                at = first.copy()
                acc = out[:, begin : begin + len(first)]
                for step in range(self.last + 1):
                    c = points[at]
                    c[at >= end] = 0
                    wide = c.astype(np.uint64) + np.uint64(1)
                    for repeat, salt in self.sampled[step]:
                        acc[repeat] += wide * salt
                    at += self.moves[step][c]
        out ^= out >> np.uint64(29)
        with np.errstate(over="ignore"):
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


@dataclass
class Index:
    size: int
    stride: int
    keys: list[np.ndarray]
    owners: list[np.ndarray]
    offsets: list[np.ndarray]
    maybe: list[np.ndarray]


@dataclass
class Pieces:
    """Pieces of ``width`` characters: hash, item, offset in it, and offset of the other half of the pair (-1: none)."""

    width: int
    keys: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray
    others: np.ndarray
    maybe: np.ndarray


def _one_edit(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each row of ``pattern`` is a beginning of the same row of ``text`` (one longer) but for one edit at most."""
    width = pattern.shape[1]
    at = np.arange(width)
    same = pattern == text[:, :width]
    first = np.where(same.all(axis=1), width, same.argmin(axis=1))[:, None]
    replaced = same.sum(axis=1) >= width - 1
    added = ((pattern == text[:, 1:]) | (at < first)).all(axis=1)
    lost = ((pattern[:, 1:] == text[:, : width - 1]) | (at[1:] <= first)).all(axis=1)
    return replaced | added | lost


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_substring(pattern: str, text: str, of: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of the text, and where the first such substring ends."""
    of, n = masks(pattern) if of is None else of, len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    best, end = n, 0
    for i, c in enumerate(text):
        eq = of.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        h_up = (down | ~(d0 | up)) & full
        h_down = up & d0
        if h_up & top:
            distance += 1
        elif h_down & top:
            distance -= 1
        # A substring may begin anywhere: the upper edge of the table is 0.
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up = (h_down | ~(d0 | h_up)) & full
        down = h_up & d0
        if distance < best:
            best, end = distance, i + 1
    return best, end


class Finder:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS):
        self.items = [(key, normal(text)) for key, text in items if text and not text.isspace()]
        self.edits = [int(edits * len(t)) for _, t in self.items]
        self.masks = [masks(t) for _, t in self.items]
        self.embeddings: dict[int, Embedding] = {}
        self.indexes: list[Index] = []
        groups: dict[int, list[int]] = {}
        for i, (_, t) in enumerate(self.items):
            size = next(s for s, _ in CLASSES if len(t) >= 1.5 * s or s == 1)
            groups.setdefault(size, []).append(i)
        for size, stride in CLASSES:
            if size in groups:
                self.indexes.append(self._index(size, stride, groups[size]))
        self.points = [_points(t) for _, t in self.items]
        lengths = np.array([len(p) for p in self.points], np.int64)
        self.begins = np.cumsum(lengths) - lengths
        self.points = np.concatenate(self.points) if self.items else np.zeros(0, np.uint8)
        self.lengths, self.pieces = lengths, self._pieces()
        self.short = np.array([len(t) < SHORT and " " in t for _, t in self.items], bool)

    def _pieces(self) -> list[Pieces]:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            n = self.edits[i] + 1
            step = len(t) // n
            width = min(step, WIDEST)
            for piece in range(n if step else 0):
                # In a pair the halves touch: the first is taken from its end.
                other = piece ^ 1
                starts = [p * step + (step - width if p % 2 == 0 and p + 1 < n else 0) for p in (piece, other)]
                rows.setdefault(width, []).append((i, starts[0], starts[1] if other < n else -1))
        out = []
        for width, members in sorted(rows.items()):
            owners, offsets, others = np.array(members, np.int64).T
            cut = self.points[(self.begins[owners] + offsets)[:, None] + np.arange(width)].astype(np.uint64)
            with np.errstate(over="ignore"):
                keys = (cut * POWERS[:width]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << PIECE_BITS, bool)
            maybe[(keys >> np.uint64(64 - PIECE_BITS)).astype(np.int64)] = True
            out.append(Pieces(width, keys[order], owners[order], offsets[order], others[order], maybe))
        return out

    def _beside(self, pieces: Pieces, row: np.ndarray, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Whether the other half of each piece ``row`` found at ``at`` stands beside it with one edit at most."""
        width, out = pieces.width, pieces.others[row] < 0
        step = np.arange(width + 1)
        for after in (True, False):
            of = np.flatnonzero(~out & ((pieces.others[row] > pieces.offsets[row]) == after))
            if len(of):
                base = self.begins[pieces.owners[row[of]]] + pieces.others[row[of]]
                # What lies before the piece is compared backwards.
                half = base[:, None] + (step[:width] if after else width - 1 - step[:width])
                text = at[of][:, None] + (width + step if after else -1 - step)
                inside = (text >= 0) & (text < len(points))
                out[of] = _one_edit(self.points[half], np.where(inside, points[np.where(inside, text, 0)], 0))
        return out

    def _pieces_in(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place) where a piece and the other half of its pair fit."""
        hashes = np.zeros(len(points), np.uint64)
        wide = points.astype(np.uint64)
        done = 0
        for pieces in self.pieces:
            with np.errstate(over="ignore"):
                for i in range(done, min(pieces.width, len(points))):
                    hashes[: len(points) - i] += wide[i:] * POWERS[i]
            done = pieces.width
            at = np.flatnonzero(pieces.maybe[(hashes >> np.uint64(64 - PIECE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(pieces.keys, hashes[at], "left"), np.searchsorted(pieces.keys, hashes[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            sums = np.cumsum(n)
            # As many places at a time as their pieces fill some MB.
            for begin in range(0, int(sums[-1]) if len(n) else 0, 65_536):
                each = np.arange(begin, min(begin + 65_536, int(sums[-1])))
                of = np.searchsorted(sums, each, side="right")
                row, where = low[of] + each - (sums - n)[of], at[of]
                text = np.searchsorted(begins, where, side="right") - 1
                fine = np.flatnonzero(where + pieces.width <= begins[text] + sizes[text])
                fine = fine[self._beside(pieces, row[fine], where[fine], points)]
                row, where, text = row[fine], where[fine], text[fine]
                if self.short.any():
                    owner, first = pieces.owners[row], where - pieces.offsets[row]
                    fine = [not self.short[i] or bool((points[max(0, a - 1) : a + self.lengths[i] + 1] == SPACE).any()) for i, a in zip(owner, first)]
                    row, where, text = row[fine], where[fine], text[fine]
                yield from zip(text.tolist(), pieces.owners[row].tolist(), (where - begins[text] - pieces.offsets[row]).tolist())

    def _index(self, size: int, stride: int, members: list[int]) -> Index:
        walk = self.embeddings[size] = Embedding(size)
        found, owners, offsets = [], [], []
        for i in members:
            points = _points(self.items[i][1])
            starts = _word_starts(points, SPACE)
            fits = starts[starts + size <= len(points)]
            starts = fits if len(fits) else starts[:1]
            found.append(walk.hashes(np.r_[points, np.zeros(size + 1, np.uint8)], starts))
            owners.append(np.full(len(starts), i))
            offsets.append(starts)
        hashes, owner, offset = np.concatenate(found, axis=1), np.concatenate(owners), np.concatenate(offsets)
        out = Index(size, stride, [], [], [], [])
        for row in hashes:
            order = np.argsort(row, kind="stable")
            out.keys.append(row[order])
            out.owners.append(owner[order])
            out.offsets.append(offset[order])
            maybe = np.zeros(1 << BITS, bool)
            maybe[(row >> np.uint64(64 - BITS)).astype(np.int64)] = True
            out.maybe.append(maybe)
        return out

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, item, place of the item's begin in the text) for every hit, in the order of texts."""
        sizes = np.array([len(t) for t in texts])
        points = _points("".join(texts))
        begins = np.cumsum(sizes) - sizes
        found: set[tuple[int, int, int]] = set()
        for index in self.indexes:
            buf = np.r_[points, np.zeros(index.size + 1, np.uint8)]
            gap = points == SPACE
            first = np.zeros(len(points), bool)
            first[begins[sizes > 0]] = True
            starts = np.flatnonzero(~gap & (first | np.r_[True, gap[:-1]]))
            of = np.searchsorted(begins, starts, side="right") - 1
            # Every stride-th word of each text, and only windows that end within it unless it is short.
            number = np.arange(len(starts)) - np.searchsorted(of, of)
            fine = (number % index.stride == 0) & ((starts + index.size <= begins[of] + sizes[of]) | (number == 0))
            starts, of = starts[fine], of[fine]
            hashes = self.embeddings[index.size].hashes(buf, starts)
            for repeat, row in enumerate(hashes):
                hit = np.flatnonzero(index.maybe[repeat][(row >> np.uint64(64 - BITS)).astype(np.int64)])
                keys = index.keys[repeat]
                low, high = np.searchsorted(keys, row[hit], "left"), np.searchsorted(keys, row[hit], "right")
                for h, a, b in zip(hit[high > low], low[high > low], high[high > low]):
                    for i, offset in zip(index.owners[repeat][a:b].tolist(), index.offsets[repeat][a:b].tolist()):
                        found.add((int(of[h]), i, int(starts[h] - begins[of[h]]) - offset))
        found.update(self._pieces_in(points, begins, sizes))
        yield from sorted(found)

    def find(self, raw: list[str | None]) -> list[list[dict]]:
        """For each text the items in it: item_id, distance, and the matching span in code points."""
        out: list[list[dict]] = [[] for _ in raw]
        if not self.items:
            return out
        texts = [normal(t) if t else "" for t in raw]
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= 1_000_000):
                size += len(texts[end])
                end += 1
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for t, i, place in self.candidates(texts[begin:end]) if size else ():
                k, pattern, text = self.edits[i], self.items[i][1], texts[begin + t]
                low, high = max(0, place - k), place + len(pattern) + k
                if any(a <= low and high <= b for a, b in seen.get((t, i), ())):
                    continue
                low, high = max(0, low - k), high + k
                seen.setdefault((t, i), []).append((low, high))
                distance, stop = best_substring(pattern, text[low:high], self.masks[i])
                if distance <= k and distance < best.get((t, i), (k + 1,))[0]:
                    back = best_substring(pattern[::-1], text[low : low + stop][::-1][: len(pattern) + distance])
                    best[t, i] = (distance, low + stop - back[1], low + stop)
            for (t, i), (distance, start, stop) in sorted(best.items()):
                out[begin + t].append({"item_id": self.items[i][0], "distance": distance, "start": start, "end": stop})
            begin = end
        return out


def finders(benchmark: DataFrame, edits: float = EDITS, block: int = BLOCK) -> list[Finder]:
    """One finder per block of benchmark items (item_id, text), read through an iterator."""
    out, part = [], []
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator()
    for row in rows:
        part.append((row.item_id, row.text))
        if len(part) == block:
            out.append(Finder(part, edits))
            part = []
    return [*out, Finder(part, edits)] if part else out


def matches(found: list[Finder], text: Column) -> Column:
    """An array of the items in a text (see RESULT)."""

    def one(finder: Finder) -> Column:
        @F.pandas_udf(RESULT)
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(finder.find([t if isinstance(t, str) else None for t in texts]))

        return of(text)

    return F.concat(*[one(f) for f in found]) if found else F.array().cast(RESULT)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are."""
    return docs.where(F.size(matches(finders(benchmark, edits), F.col("text"))) == 0)


def op1_decontaminate(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = docs.select("doc_id", F.explode(matches(finders(benchmark), F.col("text"))).alias("found"))
    return found.select("doc_id", "found.item_id", "found.distance", "found.start", "found.end")

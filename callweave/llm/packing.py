"""Best-fit packing of token sequences: bounded-space online best fit over pieces of documents.

A document's tokens, closed by END, are cut only if they exceed the capacity; then every piece but the first is full. Pieces that fill a
sequence are sequences of their own. The others arrive one after the other, in an order given by a hash, at a packer that holds at most OPEN open
bins. Bit f of a bitset says whether a bin with f free places is open, so the best fit for n tokens is the lowest bit from n on. If a new bin would
be one too many, the fullest open one closes: the lowest bit of all.

Spark tokenises where the texts lie and writes one short row for each piece. Pieces are then dealt by a hash to packers, one for each SHARE pieces,
so that no task packs everything, no key can be hot, and the bins that a packer leaves open at its end are few next to those it fills. Tokens are
never shuffled.

Tokenising memoises: a text is cut before every space or line end that follows something else than white space, where a byte-level
pre-tokeniser always cuts, and equal chunks are encoded once as long as a task remembers them. Memory is bounded by MEMO chunks, and by the
chunks and tokens of BATCH characters or of one text.

Defined cases: a null or empty text is END alone; repeated rows and equal ids are packed as documents of their own; a null id stays null; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import discard, need, written

CAPACITY = 1024
#: The id that closes a document.
END = 2
#: Bins that a packer holds open.
OPEN = 1024
#: Pieces for each packer.
SHARE = 30_000
#: Chunks whose tokens a task remembers.
MEMO = 800_000
#: Characters of texts that are encoded at once.
BATCH = 4_000_000
#: Sequence numbers of a packer.
NUMBERS = 2**40

CHUNK = re.compile(r"(?<=\S)(?=[ \n])")
#: A word whose signs at the end are encoded apart: after a letter or digit a pre-tokeniser cuts before any sign but an apostrophe.
SIGNS = re.compile(r"(.*[A-Za-z0-9])([!-&(-/:-@\[-`{-~]+)", re.S)
#: Words that are encoded as one text, a line end between them.
JOINED = 2000
#: Letters with signs after them, perhaps after a line end. A pre-tokeniser keeps a run of letters whole, with the space before it.
LETTERS = re.compile(r"(\n?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")
#: How a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def shown_bytes(text: str) -> str:
    """The UTF-8 bytes of a text as a byte-level vocabulary writes them, by searches: ``translate`` looks every character up."""
    shown = text.encode().decode("latin-1")
    for b, other in BYTES.items():
        shown = shown.replace(chr(b), chr(other))
    return shown


class Encoder:
    """Token ids of whole texts, chunks encoded once."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        # The tokens of chunks, and of words with the space before them.
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        gap = self._ids(["\n"])[0]
        self.gap = int(gap[0]) if len(gap) == 1 else None
        # Whether a run of letters can go to the model as it is.
        cut, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        bytewise = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        self.bytewise = bytewise and self.tokenizer.normalizer is None and self.gap is not None and all(t.special for t in added)

    def _ids(self, chunks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _chunks(self, distinct: set[str]) -> dict[str, bytes]:
        """The tokens of chunks."""
        known = self.chunks
        if len(known) + len(distinct) > MEMO:
            known = self.chunks = {}
        fresh = [c for c in distinct if c not in known]
        known.update((c, ids.tobytes()) for c, ids in zip(fresh, self._ids(fresh)))
        return known

    def _words(self, distinct: set[str], fresh: set[str]) -> dict[str, bytes]:
        """The tokens of words, each with a space before it unless it begins with a line end; ``fresh`` are those not known yet."""
        known = self.words
        if len(known) + 2 * len(distinct) > MEMO:
            known = self.words = {c: known[c] for c in distinct if c in known}
        found = [m for m in map(LETTERS.fullmatch, fresh) if m] if self.bytewise else []
        self._letters(known, list({m[1] for m in found}.difference(known)))
        fresh = fresh.difference([m[0] for m in found])
        found = [m for m in found if m[2]]
        signed = [m for m in map(SIGNS.fullmatch, fresh) if m]
        self._encode(known, {*fresh.difference([m[0] for m in signed]), *[m[1] for m in signed]}.difference(known))
        found += signed
        signs = self._chunks({m[2] for m in found})
        known.update([(m[0], known[m[1]] + signs[m[2]]) for m in found])
        return known

    def _letters(self, known: dict[str, bytes], heads: list[str]) -> None:
        """The tokens of letters: of the model alone, since nothing cuts inside them. A line end is a token of its own."""
        tokenize = self.tokenizer.model.tokenize
        for begin in range(0, len(heads), JOINED):
            some = heads[begin : begin + JOINED]
            shown = shown_bytes("\n".join([h[1:] if h[0] == "\n" else " " + h for h in some]))
            ids, ends = [], [0]
            for h, word in zip(some, shown.split(chr(BYTES[10]))):
                if h[0] == "\n":
                    ids.append(self.gap)
                ids += [t.id for t in tokenize(word)]
                ends.append(4 * len(ids))
            raw = np.array(ids, "<u4").tobytes()
            known.update(zip(some, [raw[a:b] for a, b in zip(ends, ends[1:])]))

    def _encode(self, known: dict[str, bytes], fresh: set[str]) -> None:
        # A word between line ends is cut there if it begins with no white space; a line end is then a token of its own.
        plain = [w for w in fresh if self.gap is not None and not w[0].isspace()]
        for begin in range(0, len(plain), JOINED):
            some = plain[begin : begin + JOINED]
            ids = self._ids([" " + "\n ".join(some)])[0]
            ends = [*(np.flatnonzero(ids == self.gap) * 4).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            known.update(zip(some, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]))
        others = [w for w in fresh if w not in known]
        spaced = [w if w[0] == "\n" else " " + w for w in others]
        known.update((w, ids.tobytes()) for w, ids in zip(others, self._ids(spaced)))

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        # Every line end begins a word of its own, so that words are what stands between single spaces.
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        words = set().union(*parts)
        # A space after white space does not begin a chunk. Such words are never remembered.
        fresh = words.difference(self.words)
        unsafe = {w for w in fresh if not w or w[-1].isspace()}
        safe = lambda head, part: head and not head[-1].isspace() and (not unsafe or unsafe.isdisjoint(part))
        plain = [bool(safe(h, p)) for h, p in zip(heads, parts)]
        split = [[h] if ok else CHUNK.split(t) if t else [] for t, h, ok in zip(texts, heads, plain)]
        known = self._words(words, fresh - unsafe if unsafe else fresh)
        chunks = self._chunks(set().union(*split))
        for part, first, ok in zip(parts, split, plain):
            head = b"".join([chunks[c] for c in first])
            yield head + b"".join(map(known.__getitem__, part)) if ok else head

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            yield from self._some(texts[begin:end])
            begin = end


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) of ``docs`` (doc_id, text); ``row`` is a number of the input row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gc
        import os

        gc.disable()  # what is remembered has no cycles, and looking for some costs a twelfth of the time
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        encoder = Encoder(file)
        last = np.array([end], "<u4").tobytes()
        names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
        try:
            for batch in batches:
                out: list[tuple] = []
                ids = batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None)
                for doc_id, row, found in zip(ids, batch["row"], encoder.texts(batch["text"].tolist())):
                    found += last
                    for piece, (start, length) in enumerate(cuts(len(found) // 4, capacity)):
                        out.append((doc_id, row, piece, start, length, zlib.crc32(found[4 * start : 4 * (start + length)])))
                frame = pd.DataFrame(out, columns=names)
                yield frame.astype({"doc_id": "Int64"})
        finally:
            gc.enable()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInPandas(cut, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Best fit into at most ``most`` open bins."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, bit: int) -> int:
        number = self.bins[bit].pop()
        if not self.bins[bit]:
            self.free &= ~(1 << bit)
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and where it begins there."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
            self.open -= 1
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            room, number = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - room


def pack(cut: DataFrame, capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """``cut`` (row, piece, length, ...) with ``sequence_id`` and ``offset``."""
    packers = -(-cut.where(F.col("length") < capacity).count() // SHARE) or 1
    names = [*cut.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{c}` {t}" for c, t in [*cut.dtypes, ("sequence_id", "long"), ("offset", "long")])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * NUMBERS
        packer = Packer(capacity, most)
        for batch in batches:
            found = [packer.place(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = np.array([base + number for number, _ in found], np.int64)
            batch["offset"] = np.array([at for _, at in found], np.int64)
            yield batch[names]

    # The order of arrival is fixed, so a packer that runs again packs alike.
    dealt = cut.repartition(packers, F.xxhash64("row", "piece")).sortWithinPartitions(F.xxhash64("piece", "row"), "row", "piece")
    return dealt.mapInPandas(fill, schema)


def packed(docs: DataFrame, file: str, capacity: int = CAPACITY, most: int = OPEN, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    need(docs, ("doc_id", "text"))
    cut = written(pieces(docs, file, capacity, end), "pieces")
    out = written(pack(cut, capacity, most).drop("row"), "packed")
    discard(cut)
    return out


def op11_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))

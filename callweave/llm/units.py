"""Lines and paragraphs of documents as rows, and removing some of them again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE, PARAGRAPH = re.compile(r"\n"), re.compile(r"\n[\x20\x09-\x0D]*\n")
SPLITS = {"line": LINE, "paragraph": PARAGRAPH}
NO_ID = -(2**63)
#: Rows per Arrow batch made at once.
CHUNK = 20_000


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (the input row as a struct), ``id`` (null: the least long), ``mark`` (hash of the text) and ``text``.

    Rows with equal id and text have the same key: they count as one document and share one result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def spans(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """Units with their end marks, as code point offsets; together they are the whole text."""
    at = 0
    for m in SPLITS[unit].finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def normal(unit: str) -> str:
    """Lower case, one space between words. A unit without words becomes empty.

    What separates words is what bytes are split at.
    """
    return b" ".join(unit.lower().encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


def digest(unit: str) -> bytes:
    return hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unit_rows(keys: DataFrame, unit: str = "line", least_words: int = 1) -> DataFrame:
    """One row (id, mark, place, start, end, digest) for each unit that has at least so many words, one at least."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "mark", "place", "start", "end", "digest"]
        out: list[tuple] = []
        for batch in batches:
            for key, mark, text in zip(batch["id"], batch["mark"], batch["text"]):
                for place, (start, end) in enumerate(spans(text, unit)):
                    words = normal(text[start:end])
                    if words and words.count(" ") + 1 >= least_words:
                        out.append((key, mark, place, start, end, digest(words)))
                        if len(out) >= CHUNK:
                            yield pd.DataFrame(out, columns=names)
                            out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return keys.select("id", "mark", "text").mapInPandas(cut, "id long, mark long, place int, start int, end int, digest binary")


RESULT = (
    "struct<kept:string,n_bytes:long,n_removed:long,n_spans:int,kept_sha256:string,"
    "removed:array<struct<start:int,end:int>>>"
)


def cut_out(text: str, removed) -> tuple:
    """Remove (start, end) pieces; pieces that touch become one span."""
    merged: list[list[int]] = []
    for start, end in sorted(set(removed)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    kept, at, gone = [], 0, 0
    for start, end in merged:
        kept.append(text[at:start])
        gone += len(text[start:end].encode("utf-8", "surrogatepass"))
        at = end
    kept.append(text[at:])
    rest = "".join(kept)
    raw = rest.encode("utf-8", "surrogatepass")
    return rest, len(raw) + gone, gone, len(merged), hashlib.sha256(raw).hexdigest(), [{"start": a, "end": b} for a, b in merged]


def without(text: Column, pieces: Column) -> Column:
    """A struct (see RESULT) of a text without ``pieces`` (array of start and end)."""

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        for texts, lists in batches:
            found = [cut_out(t or "", [(p["start"], p["end"]) for p in (ps if ps is not None else ())]) for t, ps in zip(texts, lists)]
            yield pd.DataFrame(found, columns=names)

    # Else a filter on the result would be pushed below it, and every text be cut twice, by two workers at a time.
    return of.asNondeterministic()(text, pieces)


def kept_text(text: Column, pieces: Column) -> Column:
    """A text without ``pieces`` (array of start and end); null for null."""

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([None if t is None else cut_out(t, [(p["start"], p["end"]) for p in ps])[0] for t, ps in zip(texts, lists)], dtype=object)

    # As in ``without``: a filter on the result is not to cut every text again.
    return of.asNondeterministic()(text, pieces)


def with_pieces(keys: DataFrame, met: DataFrame) -> DataFrame:
    """Documents (``row``) with the ``pieces`` of theirs that are ``later`` and ``firsts``, as in ``remove_units``; null if there are none.

    The pieces of a document are collected, which its own length bounds.
    """
    piece = F.struct("start", "end")
    pieces = met.groupBy("id", "mark").agg(
        F.collect_set(F.when(F.col("later"), piece)).alias("pieces"), F.sort_array(F.collect_set(F.when(~F.col("later"), piece))).alias("firsts")
    )
    # The text goes once, within the row.
    return keys.select("row", "id", "mark").join(pieces, ["id", "mark"], "left").select("row", "pieces", "firsts")


def remove_units(keys: DataFrame, met: DataFrame) -> DataFrame:
    """Join units (id, mark, start, end, later) to their documents: row, a struct ``result`` and ``firsts``.

    Units that are ``later`` than another go; ``firsts`` lists the offsets of those that stay as the first of several.
    """
    joined = with_pieces(keys, met)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select("row", without(F.col("row.text"), F.col("pieces")).alias("result"), F.coalesce("firsts", none).alias("firsts"))

"""Text predicates and tokenizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, spelled out because a bare \s covers ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)

# Letters, digits and underscore. Combining vowel signs are not word characters here.
WORD = r"[\p{L}\p{N}_]+"
# The same plus the whole Devanagari block, so vowel signs and the danda stay inside a token.
WORD_WITH_MARKS = r"[\p{L}\p{N}_\x{0900}-\x{097F}]+"
DEVANAGARI = r"[\x{0900}-\x{097F}]"

SENTENCE_END = r"[.!?\x{0964}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def swapped(text: Column, letters: dict[str, str]) -> Column:
    """The text with some letters as others, none of which is swapped again.

    Each is a search over bytes; ``translate`` makes a string of every character of the text.
    """
    for old, new in letters.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_SPACE)


def words(text: Column) -> Column:
    """White-space separated words; an empty list for blank text."""
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(
        F.split(strip(text), f"{SPACE}+")
    )


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens_with_marks(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_WITH_MARKS), F.lit(0))


def needs_translation(text: Column, script: str = DEVANAGARI) -> Column:
    """Whether the text has any character of a script the scorer cannot read."""
    return text.rlike(script)


def scoring_text(text: Column, limit: int | None = 512) -> Column:
    """What a text scorer sees: the first ``limit`` characters (None: all), never blank."""
    head = text if limit is None else F.left(text, F.lit(limit))
    return F.when(is_blank(head), F.lit("neutral")).otherwise(strip(head))


def matches_query(text: Column, query: str) -> Column:
    """Case-insensitive substring search; a blank query finds everything."""
    if not query.strip():
        return F.lit(True)
    return F.contains(F.lower(text), F.lit(query.lower()))


def job_id(filename: Column, prefix: str = "call") -> Column:
    return F.concat(F.lit(prefix + "-"), F.regexp_replace(filename, "[^A-Za-z0-9_-]", "_"))


def clock_seconds(stamp: Column) -> Column:
    """Seconds from ``s``, ``m:s``, ``h:m:s`` or the two ``m:s:hundredths`` spellings."""
    parts = F.split(F.regexp_replace(stamp, f"{SPACE}+", ""), ":")
    at = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
    three = (
        F.when((at[0] == 0) & (at[1] < 60) & (at[2] < 100), at[1] + at[2] / 100.0)
        .when(at[0] < 10, at[0] * 60.0 + at[1] + at[2] / 100.0)
        .otherwise(at[0] * 3600.0 + at[1] * 60.0 + at[2])
    )
    return (
        F.when(F.size(parts) == 1, at[0])
        .when(F.size(parts) == 2, at[0] * 60.0 + at[1])
        .when(F.size(parts) == 3, three)
    )

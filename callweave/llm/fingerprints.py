"""Document fingerprints by consistent weighted sampling.

A document is a bag of terms, each a word with the word after it (the last word alone), weighted by how often it occurs. For each
of SAMPLES samples every term draws two Gamma(2, 1) numbers r and c and a uniform b from two hashes of (sample, term). With
t = floor(ln(weight) / r + b) and a = c / exp(r (t - b) + r), the term with the least a is the sample, together with t. Two documents
agree in a sample with a probability that is their generalised Jaccard similarity: the sum of the lesser weights over the sum of
the greater. Likeness is the share of samples that agree; its standard error is 0.0625 at most.

r is the sum of two exponential numbers e1 and e2, and b = e2 / r is uniform and independent of r. With u = exp(-e1), c is split into x = c u and
c - x, which are exponential and independent as well: a term draws x = -ln v, c - x and e2. If it occurs once, t is 0 and a is x, so the least a is
the greatest v, which is a hash as it stands; no logarithm is taken. Terms that occur more often are compared by v = exp(-a). Terms that a text
and its edited text have equally often are drawn once for both.

Everything is DataFrame functions. Documents that follow each other in descending id are brought together by blocks of 256 ids (rows without
an id: by the upper bits of the hash of their text), which are shuffled once by hash; a block also gets the first document of the next lower
block, found through a table with one row per block. Terms are aggregated where the block is, without another shuffle. No task sees more than its blocks.

Defined cases: a null text is empty; a text without words has a fingerprint of its own, equal for all such texts; null ids come last in
descending order; rows with equal ids go by a hash of the text; repeated rows count as documents of their own; an only document follows
itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import written
from callweave.llm.ranks import ranked

SAMPLES = 64
#: Samples computed in one row: of a term that occurs once, and of others. The JVM must compile what they become.
STRIP, WEIGHTED = 8, 2
BLOCK_BITS = 8
#: Rows without an id are put into blocks by this many upper bits of the hash of their text.
NULL_BITS = 16
GAP = r"[\x20\x09-\x0D]+"
#: A packed sample: v in fixed point above, a hash of the term and t below.
NAME_BITS, ORDER_BITS = 28, 35
NAME = (1 << NAME_BITS) - 1


def _uniform(bits: str, width: int = 32) -> str:
    """(0, 1) from the low bits."""
    return f"((({bits}) & {(1 << width) - 1}L) + 0.5D) * {2.0**-width}D"


def _single(k: int | str) -> str:
    """Sample g + k of a term that occurs once: the hash but for its sign. The upper bits are v, the lower ones the name."""
    return f"shiftrightunsigned(xxhash64(term, g + {k}), 1)"


def samples(terms: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """``samples`` (array of n longs, null entries for no term) per group of ``keys``, from rows with ``term`` (long, null: none) and its ``times``.

    A term that occurs once becomes n / STRIP rows of STRIP samples. The rarer ones that occur more often become rows of WEIGHTED samples,
    which take logarithms. What is kept of each sample is the greatest long.
    """
    light = F.array(*[F.lit(g) for g in range(0, n, STRIP)])
    heavy = F.array(*[F.lit(g) for g in range(0, n, WEIGHTED)])
    rows = terms.select(*keys, "term", "times", F.explode(F.when(F.col("times") > 1, heavy).otherwise(light)).alias("g"))
    each = range(WEIGHTED)
    add = lambda prefix, of: rows.select("*", *[F.expr(f"if(times > 1, {of(k)}, NULL)").alias(f"{prefix}{k}") for k in each])
    rows = add("h", _single)
    rows = add("o", lambda k: f"xxhash64(term, g + {k}, 1)")
    rows = add("x", lambda k: f"-ln({_uniform(f'shiftright(h{k}, {NAME_BITS})', ORDER_BITS)})")
    rows = add("c", lambda k: f"x{k} - ln({_uniform(f'o{k}')})")
    rows = add("e", lambda k: f"-ln({_uniform(f'shiftrightunsigned(o{k}, 32)')})")
    rows = add("r", lambda k: f"e{k} - ln(x{k} / c{k})")
    rows = add("t", lambda k: f"floor((ln(cast(times AS double)) + e{k}) / r{k})")
    # r (t - b + 1) is r (t + 1) - e2. Where t is 0, the sample is that of a single occurrence.
    order = lambda k: f"cast(exp(-c{k} * exp(e{k} - r{k} * (t{k} + 1))) * {(1 << ORDER_BITS) - 1}D AS bigint)"
    name = lambda k: f"((h{k} ^ xxhash64(t{k})) & {NAME}L)"
    rows = add("w", lambda k: f"if(t{k} = 0, h{k}, shiftleft({order(k)}, {NAME_BITS}) | {name(k)})")
    singles = range(min(STRIP, n))
    out = rows.groupBy(*keys, (F.col("times") > 1).alias("often"), "g").agg(
        *[F.expr(f"max(if(times = 1 AND term IS NOT NULL, {_single(k)}, NULL))").alias(f"m{k}") for k in singles],
        *[F.max(f"w{k}").alias(f"v{k}") for k in each],
    )
    part = F.when(F.col("often"), F.array(*[F.col(f"v{k}") for k in each])).otherwise(F.array(*[F.col(f"m{k}") for k in singles]))
    # n / STRIP and n / WEIGHTED entries for each group.
    found = lambda often: F.map_from_entries(F.collect_list(F.when(F.col("often") == often, F.struct("g", part.alias("part")))))
    both = out.groupBy(*keys).agg(found(False).alias("m"), found(True).alias("v"))
    taken = F.expr(
        f"transform(sequence(0, {n - 1}), i -> greatest(get(try_element_at(m, i - i % {len(singles)}), i % {len(singles)}), "
        f"get(try_element_at(v, i - i % {WEIGHTED}), i % {WEIGHTED})))"
    )
    return both.select(*keys, taken.alias("samples"))


def _words(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(text, GAP, " ")), " ")


def _hashed(words: str) -> Column:
    """The hashes of all terms of a column of words, in any order. A column, so that it is not split again for each term."""
    terms = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1)))
    return F.when(F.get(words, F.lit(0)) != "", terms).otherwise(F.array().cast("array<long>"))


def _runs(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, times, before, times_before, after, times_after) for each run of equal entries of ``s``, which is sorted; one null row if it is empty."""
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    begins = F.when(F.size("s") > 0, begins).otherwise(F.array().cast("array<int>"))
    runs = values.select(*keys, "s", F.size("s").alias("n"), begins.alias("begin"))
    runs = runs.select(*keys, "n", "begin", F.transform("begin", lambda i: F.get("s", i)).alias("value"))
    # Neighbours are the same arrays moved by a place.
    later = lambda c, k: F.expr(f"slice({c}, {k + 1}, size({c}))")
    earlier = lambda c: F.expr(f"concat(array(NULL), {c})")
    moved = {"value": F.col("value"), "at": F.col("begin"), "at1": later("begin", 1), "at2": later("begin", 2), "after": later("value", 1)}
    moved |= {"before": earlier("value"), "at0": earlier("begin")}
    rows = runs.select(*keys, "n", F.size("begin").alias("k"), F.posexplode_outer(F.arrays_zip(*[c.alias(a) for a, c in moved.items()])).alias("i", "x"))
    # The arrays moved to the right are longer by one.
    rows = rows.where((F.col("i") < F.col("k")) | (F.col("k") == 0)).select(*keys, "n", "x.*")
    end = lambda c: F.coalesce(c, F.col("n"))
    return rows.select(
        *keys, "value", (end("at1") - F.col("at")).alias("times"), "before", (F.col("at") - F.col("at0")).alias("times_before"),
        "after", (end("at2") - F.col("at1")).alias("times_after"),
    )


def term_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, term, times) per distinct term of ``text``; a single null term if there is none.

    A text's terms are hashed, sorted and counted as runs within its row.
    """
    words = texts.select(*keys, _words("text").alias("w"))
    runs = _runs(words.select(*keys, F.sort_array(_hashed("w")).alias("s")), keys)
    return runs.select(*keys, F.col("value").alias("term"), "times")


def _paired_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, term, times) of ``text`` (side 0) and ``changed`` (side 1); side 2 are terms that both have equally often.

    The lowest bit of a hash tells the two texts apart, so a term of the one stands before the same term of the other.
    """
    words = texts.select(*keys, _words("text").alias("w0"), _words("changed").alias("w1"))
    marked = lambda words, bit: F.transform(_hashed(words), lambda h: h.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    both = words.select(*keys, F.sort_array(F.concat(marked("w0", 0), marked("w1", 1))).alias("s"))
    runs = _runs(both, keys)
    own = F.col("value").bitwiseAND(F.lit(1)) == 0
    equal_next = own & (F.col("after") == F.col("value").bitwiseOR(F.lit(1))) & (F.col("times") == F.col("times_after"))
    equal_last = ~own & (F.col("before") == F.col("value").bitwiseAND(F.lit(-2))) & (F.col("times") == F.col("times_before"))
    fit = runs.where(~F.coalesce(equal_last, F.lit(False)))
    side = F.when(F.coalesce(equal_next, F.col("value").isNull()), 2).when(own, 0).otherwise(1)
    return fit.select(*keys, side.alias("side"), F.col("value").bitwiseAND(F.lit(-2)).alias("term"), "times")


def fingerprint(packed: Column) -> Column:
    """The names of the samples, in hexadecimal; a text without terms has none but zeros."""
    named = lambda x: F.lpad(F.lower(F.hex(F.coalesce(x.bitwiseAND(F.lit(NAME)), F.lit(0)))), NAME_BITS // 4, "0")
    return F.array_join(F.transform(packed, named), "")


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(n))


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """``row`` (the input row) and its ``fingerprint``.

    Rows with equal texts are one bag; the terms of a text are spread by a hash of the text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns(
        {"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(1), F.col("text"))}
    )
    texts = keyed.select("one", "two", "text").dropDuplicates(["one", "two"])
    found = samples(term_rows(texts, ["one", "two"]), ["one", "two"], n)
    return keyed.join(found, ["one", "two"]).select("row", fingerprint(F.col("samples")).alias("fingerprint"))


def _followers(firsts: DataFrame) -> DataFrame:
    """(to, id, mark): for each block the first document of the next lower one; after the lowest comes the highest.

    Blocks are numbered by a range-partitioned sort.
    """
    order = [F.col("block.high").desc_nulls_last(), F.col("block.low").desc_nulls_last()]
    placed = written(ranked(firsts.withColumn("all", F.lit(0)), ["all"], order, "blocks"), "blocks")
    before = placed.select(F.col("block").alias("to"), F.pmod(F.col("place") + 1, F.col("total")).alias("place"))
    return before.join(placed.select("place", "first"), "place").select("to", "first.id", "first.mark")


def followed(docs: DataFrame) -> DataFrame:
    """(block, place, id, text, follower, border): each document with the text of the next lower id.

    Border rows repeat the first document of the next block, so that a block's last document has its follower; drop them at the end.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    nulls = F.when(F.col("id").isNull(), F.shiftright("mark", 64 - NULL_BITS))
    rows = rows.select(F.struct(F.shiftright("id", BLOCK_BITS).alias("high"), nulls.alias("low")).alias("block"), "id", "mark", "text")
    # The greatest (id, mark) of each block: its first in descending order. A null id sorts below all others.
    firsts = rows.groupBy("block").agg(F.max(F.struct("id", "mark")).alias("first"))
    # Written, its size is known when the join with the texts is planned.
    leads = written(_followers(firsts), "leads")
    met = rows.select("id", "mark", "text").alias("a").join(leads.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark")))
    # Repeated rows of a first document would give more than one border row: one of them is meant.
    border = met.select(F.col("b.to").alias("block"), F.col("a.id").alias("id"), F.col("a.mark").alias("mark"), F.col("a.text").alias("text")).dropDuplicates(["block"])
    every = rows.withColumn("border", F.lit(False)).unionByName(border.withColumn("border", F.lit(True))).repartition("block")
    order = Window.partitionBy("block").orderBy("border", F.col("id").desc_nulls_last(), F.col("mark").desc())
    return every.select(
        "block", F.row_number().over(order).alias("place"), "id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("follower"), "border"
    )


def edited(text: Column, follower: Column) -> Column:
    """The last half of the text replaced by as many first code points of the follower."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(follower, F.lit(1), half))


def op8_fingerprints(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = followed(docs)
    changed = edited(F.col("text"), F.col("follower"))
    facts = ["block", "place", "border", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(
        "block", "place", "border", F.col("id").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "text", changed.alias("changed")
    ).withColumn("edited_sha256", F.sha2(F.col("changed").cast("binary"), 256))
    found = samples(_paired_rows(rows.select(*facts, "text", "changed"), facts), [*facts, "side"])
    sides = found.groupBy(*facts).agg(*[F.max(F.when(F.col("side") == v, F.col("samples"))).alias(f"s{v}") for v in (0, 1, 2)])
    best = lambda v: F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.greatest(F.get(f"s{v}", i), F.get("s2", i)))
    both = sides.select(*facts, best(0).alias("own"), best(1).alias("changed"))
    following = Window.partitionBy("block").orderBy("place")
    met = both.withColumn("next", F.lead("own").over(following)).where(~F.col("border"))
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )

"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of the source. The
documents are put in order, their expected copies are added up from one offset per source, and a
document is taken once for every integer that the running sum passes. The order goes by size class,
so that each stretch of the order has documents of about one size and the words taken stay near the
target.

The running sum is never made by one task: a source is cut into blocks of (size class, salt), blocks
are counted with map-side partial sums, the counts (at most 256 classes x SALTS for a source) are
added up, and only rows within a block are sorted.

Defined cases: a null text has size 0; a null source is a source, the last one; a null id takes the
first salt and sorts first; repeated rows count as documents of their own; an empty table gives an
empty result; a source without words has target 0 and nothing of it is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import word_count, written

SALTS = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def size_class(size: Column) -> Column:
    """Eight classes to an octave, growing with size."""
    octave = F.length(F.bin(size)) - 1
    fine = F.floor(size / F.pow(F.lit(2.0), octave - 3))
    return F.when(size < 8, size).otherwise(8 * octave + fine).cast("int")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source's name and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP
) -> DataFrame:
    """Add ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share`` x all
    sizes. A target stops at ``cap`` x its source's size; the excess goes to the others by weight.
    With the sources ordered by size per weight, those that stop come first: a source stops if the
    share per weight of what is left for it and those after it is above its own limit.

    The windows here run over one row per source.
    """
    if share > cap:
        raise ValueError("the share cannot exceed the cap")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    limit = F.col("source_size") * cap
    rows = rows.withColumns(
        {
            "place": F.row_number().over(order),
            "all": F.sum("source_size").over(everything) * F.lit(float(share)),
            "stopped": F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("level", (F.col("all") - F.col("stopped")) / F.col("left"))
    free = F.when(F.col("level") * F.col("weight") <= limit, F.struct("place", "level"))
    rows = rows.withColumn("first_free", F.min(free).over(everything))
    target = F.when(F.col("place") < F.col("first_free.place"), limit.cast("double")).otherwise(F.col("first_free.level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def copies(
    docs: DataFrame,
    size: Column | None = None,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = 0,
) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` has ``doc_id``, ``source`` and, if no ``size`` is given, ``text``. Returns one row per
    document: ``row`` (the input row as a struct, so that no column name can clash), ``size``,
    ``source_size``, ``target`` and ``copies``.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").alias("id"),
        (word_count(F.col("text")) if size is None else size.cast("long")).alias("size"),
    ).withColumns({"class": size_class(F.col("size")), "salt": F.pmod(F.coalesce(F.col("id"), F.lit(0)), F.lit(SALTS)).cast("int")})
    # Null sources share a block key of their own: joins below are on a key that is never null.
    sized = sized.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    # Written, so that words are counted once: the blocks read the small columns, and a filter on the class does not count again.
    sized = written(sized, "sized")
    key = ["named", "class", "salt"]
    blocks = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    targets = source_targets(
        blocks.groupBy("named").agg(F.sum("words").alias("source_size"), F.first("source").alias("source")).drop("named"),
        weights,
        share,
        cap,
    ).withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    earlier = Window.partitionBy("named").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(targets, "named")
    starts = starts.select(*key, "before", "source_size", "target", offset(F.col("source"), seed).alias("offset"))
    inside = Window.partitionBy(*key).orderBy("size", F.col("id").asc_nulls_first())
    rows = sized.withColumn("place", F.row_number().over(inside)).join(starts, key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("place")
    passed = F.floor(F.col("offset") + rate * place) - F.floor(F.col("offset") + rate * (place - 1))
    return rows.select("row", "size", "source_size", "target", passed.cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents: every input row as often as the mix takes it, with the input's columns."""
    taken = copies(docs, **settings).where(F.col("copies") > 0)
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_mixing(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("n"))
    return copies(narrow, F.col("n")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), blocked AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE 8 * (length(bin(size)) - 1) + floor(size / pow(2.0, length(bin(size)) - 4)) END::INT AS class,
         (coalesce(doc_id, 0) % {SALTS} + {SALTS}) % {SALTS} AS salt FROM docs
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sources
), placed AS (
  SELECT *, row_number() OVER o AS place, (sum(source_size) OVER ())::DOUBLE * {SHARE} AS total,
         coalesce(sum(source_size * {CAP}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
         (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST)
), levels AS (
  SELECT *, (total - stopped) / rest AS level FROM placed
), first_free AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE level * weight <= source_size * {CAP}
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.place < f.place THEN (l.source_size * {CAP})::DOUBLE ELSE f.level * l.weight END AS target,
         ('0x' || substr(md5('0:' || coalesce(l.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM levels l CROSS JOIN first_free f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST) AS place FROM blocked
), rated AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.place, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(start + rate * place) - floor(start + rate * (place - 1))) * size)::BIGINT AS taken FROM rated
"""

"""Islands in ordered rows by summaries of blocks, folded once per key and joined back once.

Rows are exchanged once, on (keys, block), and windows run inside a block as if nothing stood before it. What a block does to the rows
after it is a small summary: its first row, its last row, how many islands it opens inside. Summaries combine associatively, so
the ones before a block are folded by one window over a key's blocks, one row for each, and the result is joined to the block's rows: it
decides about the first row only. Neither rows nor summaries are cached: both branches read the columns they need.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.scans import BLOCK


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def _blocks(keys: Sequence[str]):
    """A key's blocks in order, and those before each."""
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    return order, order.rowsBetween(Window.unboundedPreceding, -1)


def _count(flag: Column) -> Column:
    return F.when(flag, 1).otherwise(0).cast("long")


def chained(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, look: Mapping[str, str], starts: Column, name: str
) -> DataFrame:
    """Add values of the row before (``look``: new column to source) and the number ``name``, from 1, of the island of each row.

    An island begins where ``starts`` holds, an expression over the row and what ``look`` adds (null in a key's first row). ``block`` must not
    decrease along ``order`` within a key.
    """
    keys = list(keys)
    inside = _inside(keys, order)
    rows = df.withColumn(BLOCK, block)
    rows = rows.withColumns({"__at": F.row_number().over(inside), **{new: F.lag(src).over(inside) for new, src in look.items()}})
    rows = rows.withColumn("__local", F.sum(_count((F.col("__at") > 1) & starts)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    others = [c for c in df.columns if c not in keys]
    totals = rows.groupBy(*keys, BLOCK).agg(
        F.max("__local").alias("__n"),
        F.max(F.when(F.col("__at") == 1, F.struct(*others))).alias("__first"),
        F.max_by(F.struct(*[F.col(src).alias(new) for new, src in look.items()]), "__at").alias("__last"),
    )
    along, before = _blocks(keys)
    heads = totals.withColumn("__look", F.lag("__last").over(along)).select(*keys, BLOCK, "__n", "__look", "__first.*", *[f"__look.{new}" for new in look])
    opens = _count(starts)
    folded = heads.select(*keys, BLOCK, "__look", "__n", opens.alias("__open"))
    earlier = F.coalesce(F.sum(F.col("__n") + F.col("__open")).over(before), F.lit(0).cast("long"))
    carry = folded.select(*keys, BLOCK, "__look", (earlier + F.col("__open")).alias("__base"))
    joined = rows.join(carry, [*keys, BLOCK])
    return joined.select(
        *df.columns,
        *[F.when(F.col("__at") == 1, F.col(f"__look.{new}")).otherwise(F.col(new)).alias(new) for new in look],
        (F.col("__base") + F.col("__local")).alias(name),
    )


def carried_maximum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, run: str, value: str, name: str
) -> DataFrame:
    """Add the block number and ``name``: the greatest ``value`` so far, before the row, within the stretch of equal ``run`` that the row belongs to.

    A block's summary is its first and last ``run``, whether that is one stretch, and the maximum of the last one. Stretches only grow in
    number, so the maximum of (stretch, value) so far tells the maximum of the current stretch.
    """
    keys = list(keys)
    inside = _inside(keys, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(BLOCK, block).withColumn("__prev", F.lag(run).over(inside))
    changed = F.col("__prev").isNull() | (F.col("__prev") != F.col(run))
    rows = rows.withColumn("__run", F.sum(_count(changed)).over(upto))
    top = F.struct("__run", F.col(value).alias("top"))
    rows = rows.withColumn("__top", F.max(top).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = F.struct(*order)
    totals = rows.groupBy(*keys, BLOCK).agg(
        F.min_by(run, ends).alias("__first"), F.max_by(run, ends).alias("__last"), F.max("__run").alias("__runs"), F.max(top).alias("__tail")
    )
    along, before = _blocks(keys)
    totals = totals.withColumn("__prev_last", F.lag("__last").over(along))
    opens = (F.col("__runs") > 1) | F.col("__prev_last").isNull() | (F.col("__prev_last") != F.col("__first"))
    totals = totals.withColumn("__chain", F.sum(_count(opens)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # A chain of blocks goes on with one stretch; the first of its blocks may hold others before it.
    tail = F.max(F.struct("__chain", F.col("__tail.top").alias("top"))).over(before)
    carry = totals.select(*keys, BLOCK, "__prev_last", tail.alias("__before"))
    joined = rows.join(carry, [*keys, BLOCK])
    own = F.when(F.col("__top.__run") == F.col("__run"), F.col("__top.top"))
    given = F.when((F.col("__run") == 1) & (F.col("__prev_last") == F.col(run)), F.col("__before.top"))
    return joined.select(*df.columns, BLOCK, F.greatest(own, given).alias(name))


def island_parts(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str, parts: Mapping[str, Column], whole: Mapping[str, Column]
) -> DataFrame:
    """One row for each island of ``rows``, which have a block number: keys, ``name`` from 1 and the aggregates ``whole``.

    Each block is reduced to the parts of islands that it holds (aggregates ``parts``). A part that the block did not open goes on with the last island
    before it; ``whole`` puts parts together.
    """
    keys = list(keys)
    local = F.sum(_count(starts)).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    held = rows.withColumn("__local", local).groupBy(*keys, BLOCK, "__local").agg(*[c.alias(n) for n, c in parts.items()])
    _, before = _blocks(keys)
    counts = held.groupBy(*keys, BLOCK).agg(F.max("__local").alias("__n"))
    counts = counts.select(*keys, BLOCK, F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__base"))
    placed = held.join(counts, [*keys, BLOCK]).withColumn(name, F.col("__base") + F.col("__local"))
    return placed.groupBy(*keys, name).agg(*[c.alias(n) for n, c in whole.items()])

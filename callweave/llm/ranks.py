"""Row numbers over a range-partitioned sort, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import written

#: monotonically_increasing_id keeps the partition above this many bits.
PART_BITS = 33


def ranked(rows: DataFrame, by: list[str], order: list[Column], purpose: str = "ranked") -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``total`` (rows) of each row within ``by``, in ``order``.

    ``by`` must not be null (wrap nullable columns in a struct). Rows are dealt to tasks by ranges of (by, order), so a key that
    fills a third of all rows is split; rows that tie in every column are split as well, in any order. Only one row for each key and
    partition goes through a window.
    """
    tie = F.monotonically_increasing_id()
    keys = [*[F.col(c).asc() for c in by], *order, F.col("tie_").asc()]
    dealt = rows.withColumn("tie_", tie).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie_")
    # The number is fixed by writing it.
    placed = written(dealt.withColumn("at_", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("at_", PART_BITS).alias("part_")
    parts = placed.groupBy(*by, part).agg(F.min("at_").alias("low_"), F.count(F.lit(1)).alias("n_"))
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"skip_": F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("low_"), "total": F.sum("n_").over(whole)})
    met = placed.withColumn("part_", part).join(parts.select(*by, "part_", "skip_", "total"), [*by, "part_"])
    return met.select(*rows.columns, (F.col("at_") + F.col("skip_")).alias("place"), "total")

"""Ordered scans and exact quantiles that survive one key holding a large share of all rows.

A plain window over ``call_id`` sorts a whole call in one task. Here every sequence is cut into
blocks of consecutive positions. Windows run inside a block, each block is reduced to one row of
totals, the totals are scanned per key, and what precedes a block is joined back to its rows. The
rows are exchanged once, on (keys, block), so no task ever sees more than one block of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.numeric import block_of

BLOCK = "__block"
BLOCK_ROWS = 65_536


def shared(df: DataFrame) -> DataFrame:
    """Rows that many branches of a plan read: computed once and kept on the executors' disks.

    Scans never do this by themselves; operators of several scans do it for what those have in common. A lost executor's part is
    computed anew. Spark drops the rows with ``spark.catalog.clearCache()`` or the session.
    """
    return df.persist(StorageLevel.DISK_ONLY)


@dataclass(frozen=True)
class Run:
    """A running aggregate: ``kind`` is sum, min, max, first or last (nulls are skipped)."""

    kind: str
    value: Column
    inclusive: bool = True


def _window_value(kind: str, value: Column) -> Column:
    if kind in ("first", "last"):
        return getattr(F, kind)(value, ignorenulls=True)
    return getattr(F, kind)(value)


def _block_total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind in ("first", "last"):
        pick = F.min_by if kind == "first" else F.max_by
        return pick(value, F.when(value.isNotNull(), F.struct(*order)))
    return getattr(F, kind)(value)


def _join_halves(kind: str, before: Column, within: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), within).otherwise(before + F.coalesce(within, F.lit(0)))
    if kind == "max":
        return F.greatest(before, within)
    if kind == "min":
        return F.least(before, within)
    if kind == "first":
        return F.coalesce(before, within)
    return F.coalesce(within, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    runs: Mapping[str, Run],
) -> DataFrame:
    """Add running aggregates over each key in ascending ``order``.

    ``block`` must not decrease along ``order`` within a key.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn(BLOCK, block)
    rows = rows.withColumns({f"__v_{n}": r.value for n, r in runs.items()})
    totals = rows.groupBy(*keys, BLOCK).agg(
        *[_block_total(r.kind, F.col(f"__v_{n}"), order).alias(f"__t_{n}") for n, r in runs.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        *keys,
        BLOCK,
        *[_window_value(r.kind, F.col(f"__t_{n}")).over(earlier).alias(f"__b_{n}") for n, r in runs.items()],
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    rows = rows.withColumns(
        {
            f"__w_{n}": _window_value(r.kind, F.col(f"__v_{n}")).over(
                inside.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
            )
            for n, r in runs.items()
        }
    )
    joined = rows.join(before, [*keys, BLOCK], "left")
    kept = [c for c in df.columns if c not in runs]
    return joined.select(
        *kept,
        *[
            _join_halves(r.kind, F.col(f"__b_{n}"), F.col(f"__w_{n}")).alias(n)
            for n, r in runs.items()
        ],
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, names: Mapping[str, str]
) -> DataFrame:
    """Add the previous row's values; ``names`` maps new column to source column."""
    packed = F.struct(*[F.col(src).alias(new) for new, src in names.items()])
    out = running(df, keys, order, block, {"__prev": Run("last", packed, inclusive=False)})
    return out.select(*df.columns, *[F.col(f"__prev.{new}").alias(new) for new in names])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str
) -> DataFrame:
    """Zero-based position of each row within its key."""
    out = running(df, keys, order, block, {name: Run("sum", F.lit(1).cast("long"))})
    return out.withColumn(name, F.col(name) - 1)


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, starts: Column, name: str
) -> DataFrame:
    """Number the islands that begin wherever ``starts`` holds."""
    flag = F.when(starts, 1).otherwise(0).cast("long")
    return running(df, keys, order, block, {name: Run("sum", flag)})


def quiet_runs(
    df: DataFrame, keys: Sequence[str], index: str, block_rows: int, member: Column
) -> DataFrame:
    """One row per maximal run of consecutive member rows: keys, first, last, length.

    All members between two non-members see the same count of non-members so far, so that count
    names the run and no look at the neighbouring row is needed.
    """
    outside = F.when(member, 0).otherwise(1).cast("long")
    rows = df.withColumn("__member", member)
    rows = running(
        rows, keys, [index], block_of(F.col(index), block_rows), {"__gap": Run("sum", outside)}
    )
    return (
        rows.where("__member")
        .groupBy(*keys, "__gap")
        .agg(
            F.min(index).alias("first_idx"),
            F.max(index).alias("last_idx"),
            F.count(F.lit(1)).alias("run_len"),
        )
        .drop("__gap")
    )


def with_halo(df: DataFrame, index: str, block_rows: int, before: int, after: int) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block.

    Adds the block number and a flag that is true on the row's own block only. A frame of up to
    ``before`` preceding and ``after`` following rows can then be taken inside a block.
    """
    idx = F.col(index)
    homes = F.array_distinct(
        F.array(
            block_of(idx, block_rows),
            block_of(F.greatest(idx - F.lit(after), F.lit(0)), block_rows),
            block_of(idx + F.lit(before), block_rows),
        )
    )
    return df.withColumn(BLOCK, F.explode(homes)).withColumn(
        "__home", F.col(BLOCK) == block_of(idx, block_rows)
    )


def expanding_moments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, values: Sequence[str]
) -> DataFrame:
    """Count, mean and population deviation of all earlier rows of the key.

    Adds ``prior_n`` and, per value, ``<value>_mean`` and ``<value>_std``. Moments of the current
    block and of everything before it are merged with the pairwise variance formula.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn(BLOCK, block)
    totals = rows.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(v).alias(f"__m_{v}") for v in values],
        *[F.var_pop(v).alias(f"__q_{v}") for v in values],
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    n0 = F.sum("__n").over(earlier)
    before = totals.select(
        *keys,
        BLOCK,
        n0.alias("__n0"),
        *[
            (F.sum(F.col("__n") * F.col(f"__m_{v}")).over(earlier) / n0).alias(f"__m0_{v}")
            for v in values
        ],
        *[
            (
                F.sum(F.col("__n") * (F.col(f"__q_{v}") + F.col(f"__m_{v}") * F.col(f"__m_{v}"))).over(earlier) / n0
            ).alias(f"__s0_{v}")
            for v in values
        ],
    )
    inside = (
        Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumns(
        {
            "__n1": F.count(F.lit(1)).over(inside),
            **{f"__m1_{v}": F.avg(v).over(inside) for v in values},
            **{f"__q1_{v}": F.var_pop(v).over(inside) for v in values},
        }
    )
    joined = rows.join(before, [*keys, BLOCK], "left").withColumn(
        "prior_n", F.coalesce("__n0", F.lit(0)) + F.col("__n1")
    )
    out = {}
    for v in values:
        n0c, n1c = F.col("__n0"), F.col("__n1")
        m0, m1 = F.col(f"__m0_{v}"), F.col(f"__m1_{v}")
        q0 = F.greatest(F.col(f"__s0_{v}") - m0 * m0, F.lit(0.0))
        both = n0c + n1c
        mean = (
            F.when(n0c.isNull(), m1).when(n1c == 0, m0).otherwise((n0c * m0 + n1c * m1) / both)
        )
        spread = (
            F.when(n0c.isNull(), F.col(f"__q1_{v}"))
            .when(n1c == 0, q0)
            .otherwise(
                (n0c * q0 + n1c * F.col(f"__q1_{v}")) / both
                + (n0c / both) * (n1c / both) * (m0 - m1) * (m0 - m1)
            )
        )
        out[f"{v}_mean"] = mean
        out[f"{v}_std"] = F.sqrt(spread)
    joined = joined.withColumns(out)
    return joined.select(*df.columns, "prior_n", *out)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float] | None = None,
    order_stats: Mapping[str, tuple[float, Column]] | None = None,
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles of one column per key with linear interpolation, plus ``n_values``; see ``column_quantiles``.

    ``order_stats`` maps a name to (approximate fraction, zero-based rank as an expression of
    ``n_values``) for the value at an exact rank.
    """
    targets = [(name, value, p, F.lit(p) * (F.col("n_values") - 1)) for name, p in (wanted or {}).items()]
    targets += [(name, value, p, rank.cast("double")) for name, (p, rank) in (order_stats or {}).items()]
    out = _ranked_values(df, list(keys), [value], targets, accuracy)
    return out.select(*keys, F.col(f"__n_{value}").alias("n_values"), *[name for name, *_ in targets])


def column_quantiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Mapping[str, float]], accuracy: int = 10_000
) -> DataFrame:
    """Exact quantiles of several columns per key: ``wanted`` maps a column to names and fractions. Columns without values give nulls.

    ``percentile`` keeps every distinct value of a group in one buffer. Here three scans of the columns do, whatever the data, and all columns and
    fractions share them. A mergeable sketch gives a bracket around every fraction. The brackets and the gaps between them are cells, which are
    counted; a rank lies in exactly one cell, so the counts tell which cells are read, and how far into them. Only the values of those go through
    a window: of n values about 4 n / accuracy for each fraction, or, where a bracket is narrower than a rank, a gap of at most about accuracy values.
    Should a sketch be off, another cell is read; the result is exact all the same.
    """
    targets = [(name, c, p, F.lit(p) * (F.col("n_values") - 1)) for c, names in wanted.items() for name, p in names.items()]
    out = _ranked_values(df, list(keys), list(wanted), targets, accuracy)
    return out.select(*keys, *[name for name, *_ in targets])


def _ranked_values(
    df: DataFrame, keys: list[str], columns: list[str], targets: list[tuple[str, str, float, Column]], accuracy: int
) -> DataFrame:
    """One row per key: ``__n_<column>`` and the targets (name, column, fraction, rank as an expression of ``n_values``)."""
    double = lambda c: F.col(c).cast("double")
    if len(columns) == 1:
        rows = df.select(*keys, F.lit(0).alias("__c"), double(columns[0]).alias("__x"))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("c"), double(c).alias("x")) for i, c in enumerate(columns)])
        rows = df.select(*keys, F.explode(each).alias("__e")).select(*keys, F.col("__e.c").alias("__c"), F.col("__e.x").alias("__x"))
    rows = rows.where(F.col("__x").isNotNull())
    own = [*keys, "__c"]
    fractions = sorted({p for _, _, p, _ in targets})
    slack = 2.0 / accuracy
    edges = [e for p in fractions for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    ranges = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n_values"), F.percentile_approx("__x", edges, accuracy).alias("__edges"))
    # Cells in order: before the first edge, then up to and with each lower and upper edge in turn; a bracket has both of its edges.
    cell = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        edge, x = F.get("__edges", F.lit(i)), F.col("__x")
        cell = F.when(x < edge if i % 2 == 0 else x <= edge, i).otherwise(cell)
    placed = rows.join(ranges, own).select(*own, "__x", cell.alias("__cell"))
    counts = placed.groupBy(*own, "__cell").agg(F.count(F.lit(1)).alias("__m"))
    whole = Window.partitionBy(*own)
    upto = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"n_values": F.sum("__m").over(whole), "__upto": F.sum("__m").over(upto)})
    before = F.col("__upto") - F.col("__m")
    picks = []
    for i, (_, c, _, rank) in enumerate(targets):
        for side, r in enumerate((F.floor(rank), F.ceil(rank))):
            hit = (F.col("__c") == columns.index(c)) & (r >= before) & (r < F.col("__upto"))
            picks.append(F.when(hit, F.struct(F.lit(2 * i + side).alias("pick"), (r - before).cast("long").alias("place"))))
    chosen = counts.select(*own, "__cell", F.array_compact(F.array(*picks)).alias("__picks")).where(F.size("__picks") > 0)
    values = placed.join(chosen, [*own, "__cell"]).groupBy(*own, "__cell", "__x").agg(F.count(F.lit(1)).alias("__m"), F.first("__picks").alias("__picks"))
    along = Window.partitionBy(*own, "__cell").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("__upto", F.sum("__m").over(along))
    inside = F.filter("__picks", lambda p: (p["place"] >= F.col("__upto") - F.col("__m")) & (p["place"] < F.col("__upto")))
    found = values.select(*keys, "__x", F.explode(inside).alias("__p")).select(*keys, "__x", "__p.pick")
    sizes = counts.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == i, F.col("n_values"))).alias(f"__n_{c}") for i, c in enumerate(columns)])
    got = found.groupBy(*keys).agg(*[F.max(F.when(F.col("pick") == i, F.col("__x"))).alias(f"__q{i}") for i in range(2 * len(targets))])
    out = got.join(sizes, keys)
    for i, (name, c, _, rank) in enumerate(targets):
        out = out.withColumn("n_values", F.col(f"__n_{c}"))
        a, b = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        out = out.withColumn(name, a + (b - a) * (rank - F.floor(rank)))
    return out

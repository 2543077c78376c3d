"""Exact running totals that stay parallel when one key holds a large share of the rows.

A plain ``sum() OVER (PARTITION BY key ORDER BY ts)`` puts a whole key into one task. Here the groups
above ``hot_rows`` are cut into time slices:

1. group sizes and time spans (combined map-side; only hot groups are kept, at most
   ``rows / hot_rows`` of them, so that table is broadcast), giving equal slices of each span,
2. the same once more for slices that got more than twice their share, over the span their own rows have: a stray
   timestamp, which stretches a group's span until all other rows fall into one slice, is cut off by that,
3. slice totals of the hot groups (combined map-side) and their running sum,
4. a window per (key, slice), plus the slice's carry.

Groups below the bound keep the plain window: their slice is the constant -1 and their carry is zero.
Slice borders are arithmetic on count/min/max, so recomputed tasks see the same slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000
ROWS_PER_SLICE = 100_000
MAX_SLICES = 100_000
LEVELS = 3


def _null_safe(left: str, right: str, names: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    )


def _place(rows: DataFrame, sizes: DataFrame, path: Sequence[str], position: str, name: str, how: str) -> DataFrame:
    """Add the slice of each row within its group of ``path``; -1 in groups that are not cut."""
    marked = rows.alias("d").join(F.broadcast(sizes.alias("s")), _null_safe("d", "s", path), how)
    share = (F.col(f"d.{position}") - F.col("s._lo")).cast("double") * F.col("s._parts") / F.col("s._span")
    at = F.when(F.col("s._parts").isNotNull(), F.floor(share).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return marked.select("d.*", at.alias(name))


def time_slices(
    df: DataFrame, keys: Sequence[str], position: str, hot_rows: int = HOT_ROWS, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame, list[str]]:
    """All rows with their slice columns, the same for rows of hot groups alone, and the names of these columns.

    Slices follow ``position``. With no hot group the second frame is empty before anything is read (an inner join).
    """
    every, hot, path, bound = df, None, list(keys), hot_rows
    for level in range(LEVELS):
        name = f"_slice{level}"
        sizes = (
            (df if hot is None else hot).groupBy(*path)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_lo"), F.max(position).alias("_hi"))
            .where(F.col("_n") > bound)
            .select(
                *path,
                "_lo",
                (F.col("_hi") - F.col("_lo") + 1).alias("_span"),
                F.least(F.ceil(F.col("_n") / rows_per_slice), F.lit(MAX_SLICES)).cast("bigint").alias("_parts"),
            )
        )
        every = _place(every, sizes, path, position, name, "left")
        hot = _place(df, sizes, path, position, name, "inner") if hot is None else _place(hot, sizes, path, position, name, "left")
        path, bound = [*path, name], 2 * rows_per_slice
    return every, hot, path[len(keys):]


def prior_totals(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie: Sequence[str],
    values: Mapping[str, str],
    hot_rows: int = HOT_ROWS,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add, per output name in ``values``, the sum of that column over all *earlier* rows of the key.

    ``position`` is a BIGINT ordering column (for example epoch microseconds), ``tie`` breaks equal
    positions. NULL values count as zero.
    """
    keys = list(keys)
    sliced, hot, slices = time_slices(df, keys, position, hot_rows, rows_per_slice)
    earlier_slices = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        hot.groupBy(*keys, *slices)
        .agg(*[F.sum(c).alias(f"_t_{o}") for o, c in values.items()])
        .select(
            *keys,
            *slices,
            *[F.coalesce(F.sum(f"_t_{o}").over(earlier_slices), F.lit(0)).alias(f"_c_{o}") for o in values],
        )
    )
    on = [*keys, *slices]
    joined = sliced.alias("d").join(carries.alias("c"), _null_safe("d", "c", on), "left").select(
        "d.*", *[F.coalesce(F.col(f"c._c_{o}"), F.lit(0)).alias(f"_c_{o}") for o in values]
    )
    inside = (
        Window.partitionBy(*on).orderBy(position, *tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_c_{o}")).alias(o)
            for o, c in values.items()
        ],
    )

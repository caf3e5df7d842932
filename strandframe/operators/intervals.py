"""Half-open intervals [start, end): overlap filters, the binned interval join, running maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.errors import InvalidCoordinates


def overlaps(start: Column, end: Column, lo, hi) -> Column:
    return (start < hi) & (end > lo)


def in_region(df: DataFrame, lo: int, hi: int, start: str = "start", end: str = "end", checked: bool = False) -> DataFrame:
    """Rows that overlap [lo, hi), by start. checked: lo > hi is an error; lo = hi gives what strictly contains it."""
    if checked and lo > hi:
        raise InvalidCoordinates(f"{lo} > {hi}")
    return df.filter(overlaps(F.col(start), F.col(end), lo, hi)).orderBy(start)


def points_in(df: DataFrame, lo, hi, point: str = "position") -> DataFrame:
    return df.filter((F.col(point) >= lo) & (F.col(point) < hi)).orderBy(point)


def running_max_end(df: DataFrame, keys: list[str], order: list[str], end: str = "end", width: int = 1 << 20) -> DataFrame:
    """The interval index as a table: each row with the largest end so far of its key, in the given order.

    In two levels, so that no task holds a whole key: the rows of a key are dealt to bins of ``width`` of their first
    order column (a number; null comes first), and a bin starts with the largest end of the key's bins before it.
    """
    place = F.coalesce(F.floor(F.col(order[0]) / width).cast("long"), F.lit(-(1 << 63)))
    binned = df.withColumn("__bin", place)
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    most = binned.groupBy(*keys, "__bin").agg(F.max(end).alias(end)).withColumn(end, F.max(end).over(earlier))
    # what a bin starts with is a row before its others: the rows themselves are shuffled once and joined with nothing
    carried = most.filter(F.col(end).isNotNull()).withColumn("__row", F.lit(0))
    w = Window.partitionBy(*keys, "__bin").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = binned.withColumn("__row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    return both.withColumn("max_end", F.max(end).over(w)).filter("__row = 1").drop("__row", "__bin")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, left_on: tuple[str, str] = ("start", "end"), right_on: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of overlapping intervals with equal keys; column names of the sides must differ but for keys.

    Both sides are put into the bins of ``width`` that they touch and joined on (keys, bin). A pair is kept in the
    later of the two first bins only, so nothing needs to be made distinct. Empty intervals overlap nothing. AQE splits
    skewed bins. Choose a width near the mean length.
    """
    (ls, le), (rs, re) = left_on, right_on

    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)
        return df.filter(F.col(s) < F.col(e)).withColumn("__bin", F.explode(F.sequence(first, last)))

    a, b = binned(left, ls, le), binned(right, rs, re)
    owner = F.greatest(F.floor(F.col(ls) / width), F.floor(F.col(rs) / width))
    joined = a.join(b, [*keys, "__bin"])
    return joined.filter((F.col("__bin") == owner) & (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs))).drop("__bin")


def merge_islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of overlapping or touching intervals: (keys, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(before >= F.col(start), 0).otherwise(1))
    island = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")

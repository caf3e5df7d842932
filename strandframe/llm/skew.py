"""Joins with one row a key, where a few keys may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this, and than one in MOST_HEAVY of all rows, are joined by broadcast: MOST_HEAVY at most.
HEAVY_ROWS = 1000
MOST_HEAVY = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: str, total: int) -> DataFrame:
    """Inner join of rows with groups: one row for each key ``on``, ``m`` of rows with that key (not returned).

    total: the number of rows, or more. Heavy keys are at most MOST_HEAVY, as each holds over one in MOST_HEAVY rows, so
    they are broadcast and their rows never meet in one task. The rest is shuffled. Null keys have no group and go.
    """
    heavy = F.col("m") > F.lit(max(HEAVY_ROWS, total // MOST_HEAVY))
    large = F.broadcast(groups.filter(heavy).drop("m"))
    marked = rows.join(F.broadcast(groups.filter(heavy).select(on)), on, "left_anti")
    return rows.join(large, on).unionByName(marked.join(groups.filter(~heavy).drop("m"), on))

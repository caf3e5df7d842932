"""Joins of rows with their groups: heavy keys are joined apart, nothing is lost or doubled."""

import collections

from pyspark.sql import functions as F

from strandframe.llm import skew


def _joined(spark, keys, total=None):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k long")
    counts = collections.Counter(k for k in keys if k is not None)
    groups = spark.createDataFrame([(k, 10 * k, m) for k, m in counts.items()], "k long, v long, m long")
    out = skew.join_groups(rows, groups, "k", len(keys) if total is None else total)
    assert sorted(out.columns) == ["i", "k", "v"]
    return sorted((r.i, r.k, r.v) for r in out.collect())


def test_heavy_light_and_null_keys(spark):
    keys = [7] * 1500 + [k % 400 + 8 for k in range(2500)] + [None] * 5
    assert _joined(spark, keys) == [(i, k, 10 * k) for i, k in enumerate(keys) if k is not None]


def test_only_light_keys_and_no_rows(spark):
    assert _joined(spark, [1, 2, 2]) == [(0, 1, 10), (1, 2, 20), (2, 2, 20)]
    assert _joined(spark, []) == []


def test_heavy_keys_are_bounded(spark):
    rows = spark.range(skew.MOST_HEAVY * 5).select((F.col("id") % 20).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("m"))
    assert skew.join_groups(rows, groups, "k", skew.MOST_HEAVY * 5).count() == skew.MOST_HEAVY * 5

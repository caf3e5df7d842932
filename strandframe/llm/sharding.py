"""Shards of near-equal size by sampled splitters.

The order of records is (first 60 bits of the text's MD5, doc_id), so equal texts lie together. Splitters are size-weighted quantiles
of a sample of at most SAMPLES keys; the records are range-partitioned by them. A range that holds over twice its share
(a large group of equal texts) is subdivided at quantiles of its own records' ids. Exact sums of the ranges (one small
row each) then place every record exactly: its shard is the eighth of all bytes in which it starts, or, in a group of
equal texts of at most TOGETHER of a shard, in which the group starts. The sample decides only how evenly the work is
dealt, and which large groups are subdivided.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import cut

#: Keys in the sample at most (24 bytes each on the driver).
SAMPLES = 100_000
#: Records of a range on average, and the most ranges.
RANGE_ROWS = 50_000
MOST_RANGES = 4096
#: A group of equal texts stays in one shard if it is not larger than this part of a shard.
TOGETHER = 0.01


def _range_of(splits):
    hashes, ids = splits

    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            i = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.int64)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            out, tied = low.copy(), np.flatnonzero(high > low)
            if len(tied):  # a splitter has this very hash: the ids decide
                both = np.concatenate((np.stack((hashes, ids)), np.stack((h[tied], i[tied]))), axis=1)
                # splitters behind equal records: a splitter is below a record only if it is smaller
                order = np.lexsort((np.arange(both.shape[1]) < len(hashes), both[1], both[0]))
                below = np.cumsum(order < len(hashes))
                place = np.empty(len(order), np.int64)
                place[order] = below
                out[tied] = place[len(hashes) :]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int32))], [*batch.schema.names, "part"])

    return run


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, under the law `bytes`.

    ``size`` is the UTF-8 length plus 1; a null text has size 1 and the CRC of nothing. Rows that are wholly equal, and
    null ids (first in order), are placed like others; equal texts share a shard if they make up TOGETHER of one at most.
    Shard k takes the rows or small groups that start in the k-th part of all bytes, so sizes differ by less than two
    records or 2 x TOGETHER of a shard. slot counts from 0 within the shard in key order. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("i"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keyed = cut(keyed)
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    out_columns = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    if not rows:
        return keyed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).select(*out_columns)
    ranges = max(2 * shards, min(MOST_RANGES, rows // RANGE_ROWS))
    wanted = min(SAMPLES, 64 * ranges)

    # Drawn with odds in proportion to the size, by a hash of the row: the same rows at every run.
    u = (F.xxhash64("h", "i", F.lit(17)).bitwiseAND((1 << 40) - 1) / float(1 << 40)).alias("u")
    drawn = keyed.filter(u < F.col("size") * (wanted / total)).select("h", "i").limit(4 * SAMPLES).toPandas().sort_values(["h", "i"])
    h, i = drawn["h"].to_numpy(np.int64), drawn["i"].to_numpy(np.int64)
    share = len(h) / ranges
    top = (1 << 63) - 1
    quantiles = [(int(h[k]), int(i[k])) for k in (int(share * j) for j in range(1, ranges))] if len(h) else []
    often = {a for (a, _), (b, _) in zip(quantiles, quantiles[1:], strict=False) if a == b}
    # A splitter stands behind its group of equal texts; an overfull group is fenced and split by id.
    marks = {(a, b) for a, b in quantiles if a in often} | {(a, -top - 1) for a in often} | {(a, top) for a, _ in quantiles}
    marks = sorted(marks)
    splits = (np.array([a for a, _ in marks], np.int64), np.array([b for _, b in marks], np.int64))
    parted = cut(keyed.mapInArrow(_range_of(splits), "doc_id long, h long, i long, size long, text_crc32 long, part int"))

    sums = parted.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy("part").collect()  # at most 3 x MOST_RANGES rows
    n, b, starts = 0, 0, []
    for r in sums:
        starts.append((r.part, n, b))
        n, b = n + r.n, b + r.b
    starts = F.broadcast(spark.createDataFrame(starts, "part int, n0 long, b0 long"))
    w = Window.partitionBy("part").orderBy("h", "i", "size", "text_crc32")
    placed = parted.withColumn("row", F.row_number().over(w) - 1).withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    group = Window.partitionBy("part", "h")
    held = F.sum("size").over(group) <= F.lit(TOGETHER * total / shards)
    placed = placed.withColumn("at", F.when(held, F.min("before").over(group)).otherwise(F.col("before")))
    placed = placed.join(starts, "part").select("doc_id", "size", "text_crc32", (F.col("row") + F.col("n0")).alias("row"), F.least(F.lit(shards - 1), F.floor((F.col("at") + F.col("b0")) * shards / F.lit(float(total)))).cast("int").alias("shard"))
    placed = cut(placed)
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row") - F.col("first")).select(*out_columns)

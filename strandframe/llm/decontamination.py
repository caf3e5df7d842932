"""Benchmark items inside long documents: size-partitioned MinHash containment search, then exact containment.

Items are partitioned by the size of their shingle set (powers of two). The MinHash sketch of an item is its m smallest
hashes (a bottom-m sketch), m being the same for a partition: the most shingles that an item of it may lack, plus one.
A document that contains the stated share of an item thus holds one sketch value at least, whatever the document's own
length is: no true match is missed, and long documents need no signature of their own. Candidates are verified by exact
containment of shingle sets.

The item side is broadcast only up to BROADCAST_SHINGLES shingles; beyond that sketches and sets are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import words
from strandframe.session import cut

#: Shingles of all items that may be broadcast (16 bytes each).
BROADCAST_SHINGLES = 2_000_000

FOUND = "doc_id long, item_id long, n_item long, n_shared long"


def _partition(n: int) -> int:
    return n.bit_length()


def sketch_size(n: int, percent: int) -> int:
    """m of the partition of n: its largest item may lack so many shingles, and one more."""
    largest = (1 << _partition(n)) - 1
    return largest - (-(-percent * largest // 100)) + 1


class Items:
    """Shingle sets of the items with their sketches, as flat arrays."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int):
        self.percent = percent
        keep = [k for k, s in enumerate(sets) if len(s)]
        self.ids = [ids[k] for k in keep]
        self.sets = [sets[k] for k in keep]
        pairs = [(v, k) for k, s in enumerate(self.sets) for v in s[: sketch_size(len(s), percent)]]
        value = np.array([v for v, _ in pairs], np.uint64)
        owner = np.array([k for _, k in pairs], np.int64)
        order = np.argsort(value, kind="stable")
        self.value, self.owner = value[order], owner[order]
        self.distinct = np.unique(value)

    def found(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the set ``tokens`` contains."""
        if not len(tokens) or not len(self.distinct):
            return []
        at = np.searchsorted(self.distinct, tokens)
        hit = tokens[self.distinct[np.minimum(at, len(self.distinct) - 1)] == tokens]
        if not len(hit):
            return []
        low, high = np.searchsorted(self.value, hit, "left"), np.searchsorted(self.value, hit, "right")
        candidates = np.unique(np.concatenate([self.owner[i:j] for i, j in zip(low, high, strict=True)]))
        out = []
        for k in candidates.tolist():
            own = self.sets[k]
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            shared = int(np.count_nonzero(tokens[at] == own))
            if 100 * shared >= self.percent * len(own):
                out.append((k, shared))
        return out


def _sets(size: int):
    def run(batches):
        for batch in batches:
            sets = [s for _, s in words.shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "tokens"])

    return run


def item_sets(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    source = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(words.freeing(_sets(size)), "id long, tokens array<long>")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, percent: int = 75, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: for each row of ``docs`` the items of whose shingles it has ``percent`` or more.

    Null and empty documents contain nothing, null and empty items are contained nowhere. A text of fewer than ``size``
    words is one shingle, so such an item is found only in a text that says just the same. Repeated rows of either table
    give a row each. Other columns are not looked at. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = item_sets(items, item_col, item_text_col, size)
    volume = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.count("*")).first()
    if volume[0] + volume[1] > broadcast_shingles:
        return _joined(source, cut(sets), size, percent)
    rows = sets.collect()
    index = spark.sparkContext.broadcast(Items([r.id for r in rows], [np.array(r.tokens, np.int64).view(np.uint64) for r in rows], percent))

    def run(batches):
        own = index.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids = batch.column(0).to_pylist()
            for row, tokens in words.shingle_sets(batch.column(1), size):
                for k, shared in own.found(tokens):
                    for column, x in zip(out, (ids[row], own.ids[k], len(own.sets[k]), shared), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "n_item", "n_shared"])

    return source.mapInArrow(words.freeing(run), FOUND)


def _joined(source: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """The same for any number of items: shingles of documents meet sketches, and then whole sets, in joins."""
    numbered = items.withColumn("item", F.monotonically_increasing_id()).withColumn("n", F.size("tokens").cast("long")).filter("n > 0")
    numbered = cut(numbered)
    # sets are sorted as unsigned numbers, so the sketch is the head of the array
    largest = F.expr("cast(pow(2, length(bin(n))) as long) - 1")
    m = largest - F.ceil(largest * percent / F.lit(100)) + 1
    sketches = numbered.select("item", F.explode(F.slice("tokens", 1, F.least(m, F.col("n")).cast("int"))).alias("token"))
    of_docs = source.withColumn("row", F.monotonically_increasing_id())
    tokens = cut(of_docs.select("doc_id", "row", "text").mapInArrow(_doc_tokens(size), "doc_id long, row long, token long"))
    candidates = tokens.join(sketches, "token").select("row", "item").distinct()
    whole = candidates.join(numbered.select("item", F.explode("tokens").alias("token")), "item")
    shared = whole.join(tokens, ["row", "token"]).groupBy("row", "doc_id", "item").agg(F.count("*").alias("n_shared"))
    named = shared.join(numbered.select("item", F.col("id").alias("item_id"), F.col("n").alias("n_item")), "item")
    return named.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).select("doc_id", "item_id", "n_item", "n_shared")


def _doc_tokens(size: int):
    def run(batches):
        for batch in batches:
            sets = [s for _, s in words.shingle_sets(batch.column(2), size)]
            counts = np.array([len(s) for s in sets], np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), counts))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat.view(np.int64))], ["doc_id", "row", "token"])

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id contains no item; rows with a null id are kept."""
    found = contained_items(docs, items, id_col, **options).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col("__found"), "left_anti")

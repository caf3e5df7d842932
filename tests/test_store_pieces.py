import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandframe.sources.store import SequenceStore

SCHEMA = "tax_id int, assembly_name string, seq_id string, part long, seq string"


def test_pieces_are_laid_end_to_end(spark, tmp_path):
    """no task holds a whole sequence, and pieces are cut at the chunks' edges."""
    rng = random.Random(3)
    rows = [(1, "a", name, p, "".join(rng.choice("acgun") for _ in range(n))) for name in "xyz" for p, n in enumerate(rng.choices((0, 1, 6, 7, 8, 14, 40), k=30))]
    rows += [(1, "a", "empty", 0, ""), (1, "a", "empty", 1, ""), (1, "a", "edge", 0, "acgtacg"), (1, "a", "edge", 1, ""), (2, "a", "x", 0, "acgt")]
    store = SequenceStore(spark, str(tmp_path), chunk=7)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    store.store_pieces(spark.createDataFrame(shuffled, SCHEMA).repartition(3))
    for key in {r[:3] for r in rows}:
        want = "".join(r[4] for r in sorted(rows) if r[:3] == key).upper()
        assert store.fetch_full(*key) == want and store.length(*key) == len(want)
        chunks = store._of(*key).orderBy("chunk_id").collect()
        assert [c.chunk_start for c in chunks] == list(range(0, max(len(want), 1), 7)) and all(len(c.seq) == 7 for c in chunks[:-1])
    with pytest.raises(ValueError):
        store.store(spark.createDataFrame([r for r in rows if r[2] == "edge"], SCHEMA).drop("part"))


def test_digests_go_by_chunks(spark, tmp_path):
    """the digest is that of the whole sequence, and a damaged chunk or a missing one is told."""
    store = SequenceStore(spark, str(tmp_path), chunk=5)
    rng = random.Random(4)
    rows = [(1, "a", name, 0, "".join(rng.choice("ACGT") for _ in range(n))) for name, n in (("w", 0), ("x", 5), ("y", 61), ("z", 23))]
    store.store_pieces(spark.createDataFrame(rows, SCHEMA))
    got = {r.seq_id: r for r in store.digests().collect()}
    assert {k: (r.length_bp, r.sha256, r.sound) for k, r in got.items()} == {r[2]: (len(r[4]), hashlib.sha256(r[4].encode()).hexdigest(), True) for r in rows}
    broken = store.table().filter("not (seq_id = 'y' and chunk_id = 3)").withColumn("crc", F.when((F.col("seq_id") == "z") & (F.col("chunk_id") == 1), 1).otherwise(F.col("crc")))
    store.table = lambda: broken
    assert {r.seq_id: r.sound for r in store.digests().collect()} == {"w": True, "x": True, "y": False, "z": False}

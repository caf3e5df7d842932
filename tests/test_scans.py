import collections
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import kmers


@pytest.fixture
def odd(spark):
    """Short, empty, missing, with symbols beyond ASCII, twice with one id, without an id, longer than a block."""
    rng = random.Random(6)
    text = lambda n, letters="ACGTUN": "".join(rng.choice(letters) for _ in range(n))
    rows = [(1, text(300)), (2, ""), (3, None), (4, text(200, "ACGÉ😀")), (5, text(90)), (5, text(90, "ACÉ")), (None, text(70)), (None, text(5)), (6, text(5000)), (7, "ACG"), (7, "ACG")]
    return rows, spark.createDataFrame(rows, "id int, seq string").repartition(3)


@pytest.mark.parametrize("block", [kmers.BLOCK, 1 << 12])
def test_counts_are_made_where_the_sequences_are(odd, monkeypatch, block):
    """no table of k-mers by id; ids that come twice, or in pieces, count once."""
    rows, df = odd
    monkeypatch.setattr(kmers, "BLOCK", block)
    sets, n = collections.defaultdict(set), collections.Counter()
    for i, s in rows:
        for w in kmers.query_kmers(s or "", 3):
            sets[i].add(w)
            n[w] += 1
    docs = collections.Counter(w for i, s in sets.items() if i is not None for w in s)
    for found in (kmers.kmer_counts(df, "id", 3), kmers.postings(df, "id", 3).groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))):
        assert sorted(tuple(r) for r in found.collect()) == sorted((w, n[w], docs[w]) for w in n)
    own = set(kmers.query_kmers("ACGUACGGTT", 3))
    want = {i: len(own & s) / len(own | s) for i, s in sets.items()}
    assert {r.id: r.jaccard for r in kmers.jaccard_of(df, "id", "ACGUACGGTT", 3).collect()} == want


def test_only_the_query_becomes_rows(odd):
    """windows of the query, and no others."""
    rows, df = odd
    own = kmers.query_kmers("ACGTTé", 3)
    want = collections.Counter((i, p, w) for i, s in rows for p, w in enumerate(kmers.query_kmers(s or "", 3)) if w in own)
    assert collections.Counter(tuple(r) for r in kmers.postings(df, "id", 3, among="ACGTTé").collect()) == want
    assert kmers.postings(df, "id", 3, among="A").count() == 0


def test_scans_are_the_full_scan(odd):
    """Every window is compared in the worker."""
    rows, df = odd
    dna = [(i, (s or "").replace("U", "T")) for i, s in rows]
    fm = [(i, "".join(c if c in "ACGT" else "A" for c in s)) for i, s in dna]
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    got = lambda df: collections.Counter(tuple(r) for r in df.collect())
    assert got(kmers.locate_approximate(df, "id", "ACGTA", 2)) == collections.Counter((i, p, far(s[p : p + 5], "ACGTA")) for i, s in fm for p in range(len(s) - 4) if far(s[p : p + 5], "ACGTA") <= 2)
    assert got(kmers.locate_exact(df, "id", "ACA")) == collections.Counter((i, p) for i, s in fm for p in range(len(s) - 2) if s[p : p + 3] == "ACA")
    below, same = collections.Counter(), collections.Counter()
    for i, s in fm:
        for p in range(len(s)):
            below[i] += s[p : p + 3] < "ACG"
            same[i] += s[p : p + 3] == "ACG"
    assert got(kmers.suffix_interval(df, "id", "ACG")) == collections.Counter((i, below[i] + 1, below[i] + 1 + same[i]) for i in same if same[i])
    matrix = [{"A": 1.5, "C": 0.25}, {"G": 2.0, "É": 0.5}]
    score = lambda w: sum(m.get(c, 0.0) for m, c in zip(matrix, w, strict=True))
    assert got(kmers.pwm_scan(df, "id", matrix, 1.5)) == collections.Counter((i, p, score(s[p : p + 2])) for i, s in dna for p in range(len(s) - 1) if score(s[p : p + 2]) >= 1.5)
    turn = dict(zip("ACGTNRYSWKMBDHV", "TGCANYRSWMKVHDB", strict=True))
    want = collections.Counter()
    for i, s in dna:
        for strand, q in (("+", s), ("-", "".join(turn.get(c, c) for c in reversed(s)))):
            for p in range(len(q) - 6):
                w = q[p : p + 7]
                if w[5:] in ("GG", "AG") and far(w[:4], "ACGT") <= 2:
                    want[i, strand, p + 4 if strand == "+" else len(q) - p - 4, w[:4], w[4:], far(w[:4], "ACGT"), 100.0 if w[5] == "G" else 25.0] += 1
    assert got(kmers.pam_sites(df, "id", "ACGU", 2)) == want

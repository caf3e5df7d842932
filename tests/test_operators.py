import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import intervals, kmers, relations


def test_interval_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(200), s + rng.randrange(0, 60), i) for i in range(n)]
    a, b = make(80), make(80)
    left = spark.createDataFrame(a, "k string, start long, end long, i int")
    right = spark.createDataFrame(b, "k string, s2 long, e2 long, j int")
    want = {(x[3], y[3]) for x, y in itertools.product(a, b) if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and x[2] > y[1]}
    got = [(r.i, r.j) for r in intervals.interval_join(left, right, ["k"], 16, right_on=("s2", "e2")).collect()]
    assert len(got) == len(want) and set(got) == want


def test_regions(spark):
    df = spark.createDataFrame([("g1", 100, 200), ("g2", 150, 250), ("g3", 300, 400)], "g string, start long, end long")
    names = lambda lo, hi: [r.g for r in intervals.in_region(df, lo, hi, checked=True).collect()]
    assert names(120, 160) == ["g1", "g2"] and names(350, 450) == ["g3"] and names(500, 600) == [] and names(180, 180) == ["g1", "g2"]
    with pytest.raises(intervals.InvalidCoordinates):
        intervals.in_region(df, 5000, 4000, checked=True)
    merged = intervals.merge_islands(df.withColumn("k", F.lit(1)), ["k"]).orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in merged] == [(100, 250, 2), (300, 400, 1)]


@pytest.fixture
def texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 3, 50, 2500, 4100))]
    return rows, spark.createDataFrame(rows, "id int, seq string")


def test_known_kmers(spark):
    df = spark.createDataFrame([("c", "ACGTACGT")], "id string, seq string")
    index = kmers.postings(df, "id", 4)
    assert sorted((r.kmer, r.pos) for r in index.collect() if r.kmer in ("ACGT", "CGTA")) == [("ACGT", 0), ("ACGT", 4), ("CGTA", 1)]
    assert kmers.jaccard(index, "id", "acgtacgu", 4).first().jaccard == 1.0
    assert kmers.jaccard(index, "id", "AC", 4).first().jaccard == 0.0
    assert kmers.shared_positions(index, "id", "ACGTGGGG", 4).first().shared == 1
    df = spark.createDataFrame([("c", "GATGCGATCGATCGATCGATCGGGCATCGATCGATC")], "id string, seq string")
    at = lambda p: sorted(r.pos for r in kmers.locate_exact(df, "id", p).collect())
    assert at("GATCG") == [5, 9, 13, 17, 28] and at("GGGCAT") == [21] and at("TTTTTT") == [] and at("") == []


def test_windows_and_slices(texts):
    rows, df = texts
    got = kmers.postings(df, "id", 11).collect()
    want = {(i, p, s[p : p + 11]) for i, s in rows for p in range(len(s) - 10)}
    assert len(got) == len(want) and {(r.id, r.pos, r.kmer) for r in got} == want
    chunks = kmers.chunk(df, "id", size=700, overlap=9)
    assert {r.id: r.seq for r in kmers.fetch_full(chunks, "id", 700).collect()} == dict(rows)
    for lo, hi in ((0, 20), (690, 1500), (2490, 2500), (7, 7)):
        assert {r.id: r.seq for r in kmers.fetch(chunks, "id", lo, hi, 700).collect() if r.seq} == {i: s[lo:hi] for i, s in rows if s[lo:hi]}
    with pytest.raises(ValueError):
        kmers.fetch(chunks, "id", 100, 50)


@pytest.mark.parametrize(("pattern", "m"), [("ACGTAC", 1), ("ACGTACGT", 2), ("ACG", 2)])
def test_approximate_is_the_full_scan(texts, pattern, m):
    rows, df = texts
    n = len(pattern)
    want = {(i, p, k) for i, s in rows for p in range(len(s) - n + 1) if (k := sum(a != b for a, b in zip(s[p : p + n], pattern, strict=True))) <= m}
    assert {tuple(r) for r in kmers.locate_approximate(df, "id", pattern, m).collect()} == want


def test_pam_sites(spark):
    seq = "ACGTACGTACTGGTTTT"
    df = spark.createDataFrame([("c", seq)], "id string, seq string")
    sites = kmers.pam_sites(df, "id", "ACGUACGUAC", 0)
    rows = sites.collect()
    assert [(r.strand, r.pos, r.pam, r.score) for r in rows] == [("+", 10, "TGG", 100.0)]
    report = kmers.offtarget_report(sites, df.select(F.length("seq").alias("length"))).first()
    assert (report.exact, report.total_bp, report.burden, report.specificity) == (1, 17, 0.0, 100.0)
    back = spark.createDataFrame([("c", "AAAACCAGTACGTACGT")], "id string, seq string")
    assert [(r.strand, r.pos) for r in kmers.pam_sites(back, "id", "ACGTACGTAC", 0).collect()] == [("-", 7)]


def test_relations(spark):
    edges = spark.createDataFrame([("CRP", "lacZ"), ("lacZ", "x"), ("CRP", "x")], "source string, target string")
    assert [r.node for r in relations.topological_depth(edges).orderBy("depth", "node").collect()] == ["CRP", "lacZ", "x"]
    with pytest.raises(relations.Cycle):
        relations.topological_depth(edges.union(spark.createDataFrame([("x", "lacZ")], edges.schema)))
    spots = spark.createDataFrame([(1, 11.0, 9.5), (2, 90.0, 90.0)], "spot_id int, x double, y double")
    cells = spark.createDataFrame([(7, 10.0, 10.0), (8, 12.0, 9.0)], "cell_id int, x double, y double")
    assert [(r.spot_id, r.cell_id) for r in relations.nearest_cell(spots, cells, 5.0).collect()] == [(1, 7)]


def test_locus_windows(spark):
    genes = spark.createDataFrame([("A", 1, "a", "c", 100, 200), ("B", 1, "a", "c", 5000, 5800), ("C", 1, "a", "c", 700, 900)], "symbol string, tax_id int, assembly_name string, chr string, start long, end long")
    seqs = spark.createDataFrame([(1, "a", "c", 800, None)], "tax_id int, assembly_name string, seq_id string, length_bp long, sha256 string")
    targets = spark.createDataFrame([(2, "A", 3)], "tax_id int, symbol string, priority int")
    got = {r.symbol: r for r in relations.locus_windows(genes, seqs, targets, 150, 50).collect()}
    assert (got["A"].fetch_start, got["A"].fetch_end, got["A"].priority) == (0, 250, 3)
    assert (got["B"].fetch_start, got["B"].fetch_end, got["B"].window_start, got["B"].window_end) == (0, 800, 5000, 5800)
    assert not got["C"].valid


def test_running_max_crosses_bins(spark):
    rows = [("a", 0, 900), ("a", 5, 7), ("a", 130, 140), ("a", 250, 260), ("a", 990, 1000), ("b", 40, 41), ("b", None, 3), (None, 10, 20), (None, 500, 600), (None, 700, 701), ("c", 1, None), ("c", 300, 310), ("a", 130, 140)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    for width in (1, 100, 1 << 20):
        out = intervals.running_max_end(df, ["k"], ["start", "end"], width=width)
        assert out.columns == ["k", "start", "end", "max_end"]
        want = []
        for key in ("a", "b", "c", None):
            most = None
            for start, end in sorted(((s, e) for k, s, e in rows if k == key), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or 0)):
                most = max((x for x in (most, end) if x is not None), default=None)
                want.append((key, start, end, most))
        assert collections.Counter(tuple(r) for r in out.collect()) == collections.Counter(want), width
    assert intervals.running_max_end(df.limit(0), ["k"], ["start", "end"]).count() == 0

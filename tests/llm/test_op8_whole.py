"""Descent and search end when nothing is left to do, not after a number of rounds."""

import collections

import numpy as np
import pytest

from strandframe.llm import ann


def test_descent_and_search_run_to_the_end(spark):
    x = np.random.default_rng(3).standard_normal((700, 24)).astype(np.float32)
    nodes = ann.cut(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").mapInArrow(ann._coded(float(abs(x).max())), "id long, vec binary"))
    graph, both = ann.neighbour_graph(nodes, 700)
    assert sum(r.changed for r in graph.select("changed").collect()) <= ann.STILL * 40 * 700
    beams = ann.greedy_search(spark.range(0, 700, 70), graph, both, nodes, 10, 256).collect()
    assert len(beams) == 10 and all(len(r.flags) == 256 and all(r.flags) for r in beams)


def test_sizes_grow_with_the_logarithm():
    for size in (ann.TREES, ann.NEIGHBOURS, ann.BEAM):
        assert ann._grown(size, 1000) == size[0] < ann._grown(size, 1 << 20) < ann._grown(size, 1 << 30)


def brute(x, queries, k=20):
    """{query: [(id, score)]}, by double precision."""
    out = {}
    for q in queries:
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -scores))[: min(k, len(x) - 1)]
        out[q] = [(int(i), float(scores[i])) for i in order]
    return out


def found(spark, x, **options):
    rows = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), **options).orderBy("query_id", "rank").collect()
    out = collections.defaultdict(list)
    for r in rows:
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scale", [1e5, 1e30, "mixed"])
def test_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 12))
    x *= 10.0 ** rng.uniform(-12, 12, (300, 1)) if scale == "mixed" else scale
    got, want = found(spark, x), brute(x, range(0, 300, 20))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_the_exact_way_is_exact(spark):
    x = np.random.default_rng(6).standard_normal((260, 7))
    got, want = found(spark, x, exact=True), brute(x, range(0, 260, 20))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_every_query_returns_all_it_can(spark, monkeypatch):
    """Graphs too thin to reach k nodes: the exact way fills up."""
    monkeypatch.setattr(ann, "NEIGHBOURS", (2, 0.0))
    monkeypatch.setattr(ann, "LARGEST", 1)
    monkeypatch.setattr(ann, "TREES", (1, 0.0))
    monkeypatch.setattr(ann, "CELL", 4)
    x = np.random.default_rng(7).standard_normal((61, 5))
    got = found(spark, x)
    assert {len(v) for v in got.values()} == {20} and len(got) == 4
    few = found(spark, x[:6])
    assert {q: [i for i, _ in v] for q, v in few.items()} == {q: [i for i, _ in v] for q, v in brute(x[:6], [0]).items()}


def test_blocks_of_long_vectors_are_small():
    for dimension in (64, 768, 12_288):
        assert 4 * dimension * 80 * ann.block_size(ann.BLOCK_NODES, 80, dimension) <= ann.BLOCK_BYTES

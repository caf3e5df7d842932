"""Nearest neighbours by largest inner product: a graph made by NN-descent, searched greedily.

Equal vectors are one node. Nodes meet first in cells of random hyperplanes; then, in rounds of joins, each node's
neighbours and reverse neighbours are compared with each other (pairs with a fresh member only) and better neighbours
replace worse ones. Nodes are dealt to blocks by hash; a block receives each vector it refers to once: its components in
half precision as parts of its largest one, and that one in double precision, so vectors of any size keep their order.
Rounds go on until hardly a neighbour changes. A query starts at its own node's neighbours, and at the nodes of largest
norm, and repeatedly expands the best unexpanded nodes of its beam until none is left; the best of the beam are scored
again in double precision on the original vectors. Trees, neighbours and beam grow with the logarithm of the number of
nodes. The exact way (``exact_candidates``) scores stated queries against all nodes in blocks; it serves every query
whose beam holds fewer nodes than it should return, and all of them on request.

Work and traffic of a round are in proportion to the number of nodes (or queries); blocks get smaller as vectors get
longer, so a task's memory does not depend on their length. Nothing is collected but the nodes of largest norm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import cut, drop_cut

#: Neighbours of a node, and as many reverse neighbours that take part in a round: at least, and for each doubling of nodes.
NEIGHBOURS = (40, 2.5)
#: Fresh neighbours of a node, the nearest first, that it brings together with the others in one round; the rest stay fresh.
FRESH = 24
#: Rounds end when this share of all neighbours is fresh at most.
STILL = 0.02
#: Hyperplane trees of the start (at least, and for each doubling of nodes), and nodes of a cell.
TREES = (8, 0.5)
CELL = 250
#: Better neighbours of a node that one block sends in a round.
SENT = 24
BLOCK_NODES = 5000
BLOCK_QUERIES = 250
#: Bytes of vectors, as 32-bit floats, that one block holds at most.
BLOCK_BYTES = 256 << 20
#: Nodes of largest norm at which every query starts as well (inner products favour them).
LARGEST = 64
#: The exact way: nodes of a block (of 64 components; fewer of longer vectors), and queries that meet them in one task.
EXACT_NODES = 50_000
EXACT_QUERIES = 2000
#: Greedy search: nodes expanded in a round, and the beam (at least, and for each doubling of nodes).
EXPANDED = 40
BEAM = (256, 16)
#: Best of the beam that are scored again in double precision.
FINAL = 64

GRAPH = "id long, ids array<long>, sims array<double>, flags array<boolean>, changed long"
EDGES = "id long, other long, sim double"


def _grown(size: tuple[int, float], count: int) -> int:
    least, doubling = size
    return max(least, math.ceil(doubling * math.log2(max(2, count))))


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: an id, and a vector of finite components, not all zero, of the commonest length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (length[0] if length else 0))


def _coded(largest: float):
    """Vectors as their largest component, as a part of ``largest``, and all components as parts of that in half precision."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            if n:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                size = np.abs(x).max(axis=1)
                small, size = (x / size[:, None]).astype(np.float16), size / largest
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() + b.tobytes() for a, b in zip(size, small, strict=True)], pa.binary())], ["id", "vec"])

    return run


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and vectors as parts of them: the inner product of two is that of the parts times both sizes."""
    values = column.to_pylist()
    if not values:
        return np.zeros(0), np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    return raw[:, :8].copy().view(np.float64).ravel(), raw[:, 8:].copy().view(np.float16).astype(np.float32)


def _cells(depth: int, trees: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))[1]
            if not len(x):
                continue
            for tree in range(trees):
                planes = np.random.default_rng(tree).standard_normal((x.shape[1], max(1, depth))).astype(np.float32)
                code = ((x @ planes > 0) @ (1 << np.arange(max(1, depth), dtype=np.int64))) if depth else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(code), batch.column(0), batch.column(1)], ["tree", "code", "id", "vec"])

    return run


def _edges(ids: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "other": pa.array(others, pa.int64()), "sim": pa.array(sims, pa.float64())})


def _within_cell(most: int):
    def run(key, table):
        ids, (size, x) = table.column("id").to_numpy(), _matrix(table.column("vec"))
        n = len(ids)
        if n < 2:
            return _edges([], [], [])
        k = min(most // 2, n - 1) if n > most + 1 else n - 1
        owner, other, sim = [], [], []
        for i in range(0, n, 1024):
            s = (x[i : i + 1024] @ x.T) * size
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            owner.append(np.repeat(ids[i : i + 1024], k))
            other.append(ids[best].ravel())
            sim.append((np.take_along_axis(s, best, 1) * size[i : i + 1024, None]).ravel())
        return _edges(np.concatenate(owner), np.concatenate(other), np.concatenate(sim))

    return run


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, fresh: np.ndarray, most: int):
    """Of edges the ``most`` best of each owner, each other once (the older one stays), sorted by owner and nearness."""
    order = np.lexsort((fresh, other, owner))
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    if len(owner):
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])))
        owner, other, sim, fresh = owner[first], other[first], sim[first], fresh[first]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = rank < most
    return owner[keep], other[keep], sim[keep], fresh[keep]


def _lists(owner, other, sim, fresh):
    """One row for each owner of sorted edges."""
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(start, len(owner)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((other, pa.int64()), (sim, pa.float64()), (fresh, pa.bool_()))]
    changed = np.add.reduceat(fresh.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return pa.table({"id": pa.array(owner[start], pa.int64()), "ids": lists[0], "sims": lists[1], "flags": lists[2], "changed": pa.array(changed)})


def _flat(table):
    """Edges of list rows."""
    counts = pc.list_value_length(table.column("ids")).to_numpy().astype(np.int64)
    flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "sims", "flags")]
    return np.repeat(table.column("id").to_numpy(), counts), flat[0], flat[1], flat[2].astype(bool)


def _merge(most: int):
    """The lists of a block, whose FRESH first fresh members have been compared, with better neighbours put in; those are
    fresh now, as are members that are still to be compared."""

    def run(key, old, new):
        owner, other, sim, fresh = _flat(old)
        seen = np.cumsum(fresh) - fresh
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
        fresh &= seen - np.repeat(seen[starts], np.diff(np.append(starts, len(owner)))) >= FRESH
        a, b, s = (new.column(c).to_numpy() for c in ("id", "other", "sim"))
        return _lists(*_best(np.concatenate((owner, a)), np.concatenate((other, b)), np.concatenate((sim, s)), np.concatenate((fresh, np.ones(len(a), bool))), most))

    return run


def _with_reverse(most: int):
    """Neighbours and the nearest reverse neighbours of each node, the kth nearness being the last of ``sims``."""

    def run(key, graph, reverse):
        owner, other, sim, fresh = _flat(graph)
        a, b, s, f = (reverse.column(c).to_numpy(zero_copy_only=False) for c in ("id", "other", "sim", "fresh"))
        a, b, s, f = _best(a, b, s, f.astype(bool), most)
        return _lists(*_best(np.concatenate((owner, a)), np.concatenate((other, b)), np.concatenate((sim, s)), np.concatenate((fresh, f)), 2 * most))

    return run


def _local_join(key, lists, vectors):
    """Neighbours of a node compared with each other: (id, other, sim) nearer than what id has already."""
    known, least = vectors.column("id").to_numpy(), vectors.column("least").to_numpy()
    size_of, x = _matrix(vectors.column("vec"))
    order = np.argsort(known)
    known, least, size_of, x = known[order], least[order], size_of[order], x[order]
    ids, flags = lists.column("ids"), lists.column("flags")
    parts, size = [], 0

    def settle():
        """The SENT best of each node so far: one sort by (node, nearness), then each other once."""
        a, b, s = (np.concatenate(p) if parts else np.zeros(0, k) for p, k in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.int64, np.int64, np.float32), strict=True))
        bits = s.astype(np.float32).view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # in the order of the numbers
        order = np.argsort((a.astype(np.uint64) << np.uint64(32)) | (~bits).astype(np.uint64))
        a, b, s = a[order], b[order], s[order]
        for width in (3 * SENT, SENT):
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
            keep = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < width
            a, b, s = a[keep], b[keep], s[keep]
            first = np.sort(np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_index=True)[1])
            a, b, s = a[first], b[first], s[first]
        return a, b, s

    for i in range(len(lists)):
        fresh = np.flatnonzero(flags[i].values.to_numpy(zero_copy_only=False))[:FRESH]
        if not len(fresh):
            continue
        at = np.searchsorted(known, ids[i].values.to_numpy())
        own = at[fresh]
        s = x[own] @ x[at].T
        product = s * size_of[own][:, None] * size_of[at]
        bound = least[at]
        for better, flip in ((product > bound[fresh][:, None], False), (product > bound[None, :], True)):
            r, c = np.nonzero(better)
            n, o = own[r], at[c]
            keep = n != o
            n, o, v = n[keep], o[keep], s[r, c][keep]
            if flip:
                n, o = o, n
            parts.append((n, o, (v * size_of[o]).astype(np.float32)))  # as seen from n: its own size orders nothing
            size += len(n)
        if size > 3_000_000:
            parts = [settle()]
            size = len(parts[0][0])
    a, b, s = settle()
    return _edges(known[a], known[b], s.astype(np.float64) * size_of[a])


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int").alias("block")


def block_size(most: int, refers: int, dimension: int) -> int:
    """Members of a block, each of which refers to so many vectors: ``most``, or as many as BLOCK_BYTES allow."""
    return max(1, min(most, BLOCK_BYTES // (4 * max(1, refers * dimension))))


def neighbour_graph(nodes: DataFrame, count: int, dimension: int = 64) -> tuple[DataFrame, DataFrame]:
    """(id, ids, sims, flags, changed) of each node, nearest first, and the same with reverse neighbours. nodes: (id, vec)."""
    most = _grown(NEIGHBOURS, count)
    blocks = max(8, count // block_size(BLOCK_NODES, 2 * most, dimension))
    depth = max(0, math.ceil(math.log2(max(1, count / CELL))))
    cells = nodes.mapInArrow(_cells(depth, _grown(TREES, count)), "tree int, code long, id long, vec binary")
    full = cells.groupBy("tree", "code").agg(F.count("*").alias("n"))
    # a cell that holds too many nodes is dealt out again by hash
    cells = cells.join(full, ["tree", "code"]).withColumn("sub", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / F.lit(2.0 * CELL)).cast("long")))
    edges = cells.groupBy("tree", "code", "sub").applyInArrow(_within_cell(most), EDGES)
    empty = nodes.sparkSession.createDataFrame([], GRAPH)
    key = _block("id", blocks)
    graph = cut(empty.groupBy(key).cogroup(edges.groupBy(key)).applyInArrow(_merge(most), GRAPH))
    while True:
        lists = _both_ways(graph, key, most)
        refs = lists.select(key.alias("at"), F.explode("ids").alias("id")).distinct()
        floor = graph.select("id", F.when(F.size("ids") < most, F.lit(float("-inf"))).otherwise(F.element_at("sims", -1)).cast("double").alias("least"))
        vectors = refs.join(nodes.join(floor, "id"), "id").select("at", "id", "vec", "least")
        better = lists.select(key, "ids", "flags").groupBy("block").cogroup(vectors.groupBy("at")).applyInArrow(_local_join, EDGES)
        step = cut(lists.groupBy(key).cogroup(better.groupBy(key)).applyInArrow(_merge(most), GRAPH))
        drop_cut(lists)
        drop_cut(graph)
        graph = step
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= STILL * most * count:
            return graph, _both_ways(graph, key, most)


def _both_ways(graph: DataFrame, key, most: int) -> DataFrame:
    each = graph.select(F.col("id").alias("other"), F.explode(F.arrays_zip("ids", "sims", "flags")).alias("e"))
    reverse = each.select(F.col("e.ids").alias("id"), "other", F.col("e.sims").alias("sim"), F.col("e.flags").alias("fresh"))
    # the nearest ones only: cut before they are shuffled to the node's block
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    reverse = reverse.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")
    return cut(graph.groupBy(key).cogroup(reverse.groupBy(key)).applyInArrow(_with_reverse(most), GRAPH))


def _expand(beam: int):
    """New candidates of each query scored and put into its beam."""

    def run(key, states, vectors):
        known, (size, x) = vectors.column("id").to_numpy(), _matrix(vectors.column("vec"))
        order = np.argsort(known)
        known, size, x = known[order], size[order], x[order]
        out: list[list] = [[], [], [], []]
        for row in states.select(["id", "ids", "sims", "flags", "found"]).to_pylist():
            q = row["id"]
            ids, sims, done = np.array(row["ids"], np.int64), np.array(row["sims"], np.float64), np.array(row["flags"], bool)
            rank = np.argsort(-sims, kind="stable")
            open_ = rank[~done[rank]][:EXPANDED]
            done[open_] = True
            new = np.setdiff1d(np.array(row["found"] or [], np.int64), np.append(ids, q))
            if len(new):
                own, at = np.searchsorted(known, q), np.searchsorted(known, new)
                s = (x[at] @ x[own]) * size[at] * size[own]
                ids, sims, done = np.concatenate((ids, new)), np.concatenate((sims, s)), np.concatenate((done, np.zeros(len(new), bool)))
                rank = np.argsort(-sims, kind="stable")[:beam]
                ids, sims, done = ids[rank], sims[rank], done[rank]
            for column, v in zip(out, (q, ids, sims, done), strict=True):
                column.append(v)
        return pa.table({"id": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())), "sims": pa.array(out[2], pa.list_(pa.float64())), "flags": pa.array(out[3], pa.list_(pa.bool_()))})

    return run


def greedy_search(queries: DataFrame, graph: DataFrame, both: DataFrame, nodes: DataFrame, count: int, beam: int, dimension: int = 64, starts: list[int] | None = None) -> DataFrame:
    """(id, ids, sims, flags): the beam of each query node when no member is left to expand. queries: (id)."""
    none = F.array().cast("array<long>")
    more = F.array(*(F.lit(x).cast("long") for x in starts)) if starts else none
    state = cut(queries.join(graph, "id").select("id", "ids", "sims", "flags").withColumn("flags", F.transform("flags", lambda _: F.lit(False))))
    refers = EXPANDED * 2 * _grown(NEIGHBOURS, 1 << 20)
    blocks = max(8, count // block_size(BLOCK_QUERIES, refers, dimension))
    links = both.select(F.col("id").alias("node"), F.col("ids").alias("next"))
    open_ = F.exists("flags", lambda z: ~z)
    while not state.filter(open_).isEmpty():
        # beams are sorted by nearness
        zipped = F.arrays_zip("ids", "flags")
        front = state.select("id", F.explode(F.slice(F.filter(zipped, lambda z: ~z["flags"]), 1, EXPANDED)).alias("f")).select("id", F.col("f.ids").alias("node"))
        found = front.join(links, "node").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("found"))
        asked = cut(state.join(found, "id", "left").withColumn("found", F.array_union(F.coalesce("found", none), more)).withColumn("block", _block("id", blocks)))
        more = none
        refs = asked.select(F.col("block").alias("at"), F.explode("found").alias("id")).unionByName(asked.select(F.col("block").alias("at"), "id")).distinct()
        vectors = refs.join(nodes, "id").select("at", "id", "vec")
        step = cut(asked.groupBy("block").cogroup(vectors.groupBy("at")).applyInArrow(_expand(beam), "id long, ids array<long>, sims array<double>, flags array<boolean>"))
        drop_cut(asked)
        drop_cut(state)
        state = step
    return state


def _scan(most: int):
    """The ``most`` nearest nodes of each query in one block, by double precision."""

    def run(key, nodes, queries):
        ids, others = queries.column("id").to_numpy(), nodes.column("other").to_numpy()
        if not len(ids) or not len(others):
            return _edges([], [], [])
        q, x = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for t, c in ((queries, "q"), (nodes, "v")))
        q, x = q.reshape(len(ids), -1), x.reshape(len(others), -1)
        k, out = min(most, len(others)), []
        for i in range(0, len(ids), 200):
            with np.errstate(over="ignore", invalid="ignore"):
                s = q[i : i + 200] @ x.T
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(ids[i : i + 200], k), others[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        return _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return run


def exact_candidates(queries: DataFrame, vectors: DataFrame, most: int, count: int, dimension: int) -> DataFrame:
    """(id, other): the ``most`` nearest nodes of each query node, from a comparison with all nodes in blocks.

    queries: (id); vectors: (id, v). Each task compares some of the queries with some of the nodes and keeps ``most`` a query.
    """
    n_blocks = max(1, math.ceil(count * max(1, dimension / 64) / EXACT_NODES))
    q_blocks = max(1, math.ceil(queries.count() / EXACT_QUERIES))
    spread = lambda blocks, name: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)
    deal = lambda blocks, name: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias(name)
    nodes = vectors.select(F.col("id").alias("other"), "v", deal(n_blocks, "nb"), spread(q_blocks, "qb"))
    asked = queries.join(vectors.select("id", F.col("v").alias("q")), "id").select("id", "q", deal(q_blocks, "qb"), spread(n_blocks, "nb"))
    found = nodes.groupBy("qb", "nb").cogroup(asked.groupBy("qb", "nb")).applyInArrow(_scan(most + 1), EDGES).filter("id != other")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("id", "other")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``.

    A row is no candidate of itself; rows with equal vectors are candidates like others. Null, empty and zero vectors,
    those with null or non-finite components or of another length than most, and null ids take no part (an inner product
    needs equal lengths). Of rows that share an id and a vector one takes part. With no more than k candidates all are
    returned, so each query has min(k, candidates) rows. An empty table gives an empty one. exact: all queries are
    compared with all rows instead of the graph's search.
    """
    rows = cut(_valid(vectors, id_col, vector_col).withColumn("h", F.sha2(F.to_json(F.struct("v")), 256)).dropDuplicates(["vec_id", "h"]))
    # The node of equal vectors is their smallest id; of its rows the k + 1 smallest can be among anyone's nearest.
    w = Window.partitionBy("h").orderBy("vec_id")
    some = rows.select("h", "vec_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    keys = cut(some.groupBy("h").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members")))
    kept = rows.join(keys.select("h", F.col("node").alias("vec_id"), "members"), ["h", "vec_id"])
    whole = cut(kept.select(F.xxhash64("h").alias("id"), "v", "members"))
    drop_cut(keys)
    size = F.array_max(F.transform("v", lambda x: F.abs(x)))
    count, largest, dimension = whole.agg(F.count("*"), F.max(size), F.max(F.size("v"))).first()
    asked = rows.filter(F.col("vec_id") % every == 0).select("h", F.col("vec_id").alias("query_id"))
    queries = asked.select(F.xxhash64("h").alias("id")).distinct()
    if count and not exact:
        nodes = cut(whole.select("id", "v").mapInArrow(_coded(largest), "id long, vec binary"))
        part = F.transform("v", lambda x: x / F.lit(largest))
        norm = F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x)
        starts = [r[0] for r in whole.select("id", norm.alias("norm")).orderBy(F.desc("norm"), "id").limit(LARGEST).collect()]
        graph, both = neighbour_graph(nodes, count, dimension)
        beams = greedy_search(queries, graph, both, nodes, max(1, queries.count()), _grown(BEAM, count), dimension, starts)
        for table in (graph, both, nodes):
            drop_cut(table)
        pairs = beams.select("id", F.explode(F.slice("ids", 1, FINAL)).alias("other"))
        short = queries.join(beams.select("id", F.size("ids").alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) < min(k, count - 1)).select("id")
        if not short.isEmpty():
            pairs = pairs.unionByName(exact_candidates(short, whole, FINAL, count, dimension)).distinct()
    else:
        pairs = exact_candidates(queries, whole, FINAL, count, dimension or 1)
    pairs = pairs.unionByName(queries.select("id", F.col("id").alias("other")))
    pairs = pairs.join(whole.select("id", F.col("v").alias("q")), "id").join(whole.select(F.col("id").alias("other"), "v", "members"), "other")
    score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = pairs.select("id", score.alias("score"), "members")
    # k + 1 of a node's candidates are enough for each of its queries, which leaves itself out
    each = scored.select("id", "score", F.explode("members").alias("vec_id"))
    near = each.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    of_query = asked.withColumn("id", F.xxhash64("h")).select("id", "query_id").join(near, "id").filter(F.col("vec_id") != F.col("query_id"))
    ranked = of_query.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Near-duplicate groups by the Jaccard similarity of word-shingle sets (token-combination prefixes).

The join is exact. Tokens are 5-word shingles (64-bit hashes), ordered from rare to frequent by their document counts:

1. *Sets.* Rows with equal sets become one node, so copies are never compared.
2. *Counts.* Each batch sends its (token, node) postings, sorted, difference-coded and dealt by token; a token in one
   node only is answered with nothing. Tokens in a stated share of all documents are found beforehand from per-batch
   sums, stay out of the shuffle and rank last: no token gathers more than that share in one task.
3. *Prefixes.* Two sets of similarity t differ, from the side of x, in at most e = |x| - ceil(t|x|) tokens. A rare token
   in the prefix counts 1; c frequent tokens of one group (a hash of the token picks the group) count c - 1, as any two
   of them are a combination. The prefix extends until this reaches e + 1, so similar sets share a single rare token or
   a pair of frequent ones (pigeonhole; the set whose prefix ends first in the common order decides). Tokens that no
   other node has come first. For partners of its size or more a set needs only the prefix for an overlap of
   2t / (1 + t) |x|, so the smaller set of a pair is met in that shorter prefix: a set with e + 1 of them has no partner and ends here.
4. *Verification.* Signatures with the same nodes are one bucket. In a few rounds each node is checked against hubs of its
   buckets that lie in other components, central ones first; then the nodes of a bucket that lie outside its largest component
   meet all others of it, sketches of the sets refute what they can, and the rest is checked. Pairs inside one component need
   no check: they could not change it. So no group of near copies is expanded into its pairs, and no component is lost.
   What is listed in the end is (nodes outside the largest component) x (nodes) of a bucket, not its square.

Large buckets are salted: their nodes are dealt to a task for each PIECE of them, and the hubs go to each.

Sizes: nodes are 64-bit set fingerprints (two different sets meet with odds n^2 / 2^65), tokens 52-bit hashes: among N distinct
tokens a share of N / 2^52 meets another (2e-6 at 10^10, 0.2 % at 10^13); such a pair counts as one token, so an overlap can be
too large by it. A batch sends each of its buckets only the nodes that have tokens there: what is shuffled is in proportion to
the tokens, whatever the number of buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import skew, words
from strandframe.llm.components import components
from strandframe.session import collect_garbage, cut, drop_cut

#: Tokens of one batch of postings.
BATCH_TOKENS = 1 << 21
BATCH_ROWS = 60_000
#: Tokens in over half of this share of a batch's sets are candidates for the broadcast table of common tokens, which holds
#: those in a quarter of it of all sets (and in COMMON_LEAST at least), the most frequent ones if there are too many (8 bytes
#: each). A batch reports so many candidates at most. The table only deals the work: results don't depend on it.
COMMON = 0.02
COMMON_LEAST = 64
MOST_REPORTED = 1 << 14
MOST_COMMON = 1 << 20
#: Postings of one bucket, on average.
BUCKET_TOKENS = 1 << 21
#: From this document count on a token is frequent: it is indexed in pairs.
FREQUENT = 64
#: Rounds of stars before the pairs between components.
STAR_ROUNDS = 3
#: A node meets one hub for each of these in a round: how much chance, against its core, decides on the hub.
HUB_CHANCE = (0, 4, 16, 64)
#: One group of frequent tokens for so many tokens of a set.
GROUP_TOKENS = 16
TOKEN_BITS = np.uint64(12)
#: 64-bit words of the parity sketch of a set.
SKETCH = 8
#: Nodes of a bucket that meet its hubs, or other nodes, in one task.
PIECE = 1000

ROWS = "kind int, doc_id long, n long, node long, key long"
POSTINGS = "key int, nodes binary, sizes binary, tokens binary, owners binary"
SHARED = "part int, nodes binary, sizes binary, counts binary, tokens binary, ranks binary"
INDEX = "sig long, node long, n long, core int, lead boolean, tokens binary, shared int, sketch array<long>"


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _fingerprint(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(words.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(tokens))
    return int(words.mix(np.array([total], np.uint64))[0])


def _batches(batches, size: int):
    """Lists of ((doc_id, key), set), each of about BATCH_TOKENS tokens."""
    ids, sets, total = [], [], 0
    for batch in batches:
        names, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for row, tokens in words.shingle_sets(batch.column(1), size):
            ids.append((names[row], keys[row]))
            sets.append(tokens)
            total += len(tokens)
            if total >= BATCH_TOKENS or len(ids) >= BATCH_ROWS:
                yield ids, sets
                ids, sets, total = [], [], 0
    if ids:
        yield ids, sets


def _nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([_fingerprint(s) if len(s) else 0 for s in sets], np.uint64)


def _distinct_sets(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    nodes, first = np.unique(_nodes_of(sets), return_index=True)
    keep = [i for i, k in enumerate(first.tolist()) if len(sets[k])]
    return nodes[keep], [sets[first[i]] for i in keep]


def _rows(size: int):
    def run(batches):
        for ids, sets in _batches(batches, size):
            nodes = _nodes_of(sets)
            names, keys = (pa.array(x, pa.int64()) for x in zip(*ids, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), names, pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(nodes.view(np.int64)), keys], ["kind", "doc_id", "n", "node", "key"])
            _, own = _distinct_sets(sets)
            if len(own) > 1:
                token, count = np.unique(np.concatenate(own) >> TOKEN_BITS, return_counts=True)
                common = count >= max(2, COMMON / 2 * len(own))  # few long sets: any token of two of them
                token, count = token[common], count[common]
                if len(token) > MOST_REPORTED:
                    most = np.argsort(-count, kind="stable")[:MOST_REPORTED]
                    token, count = token[most], count[most]
                if len(token):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.nulls(len(token), pa.int64()), pa.array(count.astype(np.int64)), pa.array(token.view(np.int64)), pa.nulls(len(token), pa.int64())], ["kind", "doc_id", "n", "node", "key"])

    return run


def _postings(size: int, buckets: int, parts: int, common):
    def run(batches):
        shift = np.uint64(64 - int(TOKEN_BITS) - int(math.log2(buckets)))
        out = []
        for _, sets in _batches(batches, size):
            nodes, sets = _distinct_sets(sets)
            if not len(nodes):
                continue
            sizes = np.array([len(s) for s in sets], np.uint32)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            token = np.concatenate(sets) >> TOKEN_BITS
            if len(common.value):
                known = common.value[np.minimum(np.searchsorted(common.value, token), len(common.value) - 1)] == token
                part = (nodes[owner[known]] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, own, by = part[order], token[known][order], owner[known][order]
                for i, j in _runs(part):
                    used, local = np.unique(by[i:j], return_inverse=True)
                    out.append((buckets + int(part[i]), nodes[used].tobytes(), sizes[used].tobytes(), own[i:j].tobytes(), local.astype("<u2").tobytes()))
                token, owner = token[~known], owner[~known]
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            bucket = (token >> shift).astype(np.int64)
            for i, j in _runs(bucket):
                used, local = np.unique(owner[i:j], return_inverse=True)
                out.append((int(bucket[i]), nodes[used].tobytes(), sizes[used].tobytes(), words.pack(token[i:j]), local.astype("<u2").tobytes()))
            yield from _emit(out, POSTINGS)
            out = []

    return run


def _runs(values: np.ndarray):
    """(start, stop) of each run of equal values."""
    if len(values):
        bounds = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))).tolist()
        yield from zip(bounds[:-1], bounds[1:], strict=True)


def _emit(rows: list[tuple], schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names)


def _answers(buckets: int, parts: int):
    """Of the postings of one bucket those of tokens that two nodes or more have, dealt by node."""

    def run(key, table):
        key = key[0].as_py()
        nodes, sizes, tokens, owners = [], [], [], []
        base = 0
        for node, size, token, owner in zip(*(table.column(c).to_pylist() for c in ("nodes", "sizes", "tokens", "owners")), strict=True):
            node = np.frombuffer(node, np.uint64)
            nodes.append(node)
            sizes.append(np.frombuffer(size, np.uint32))
            tokens.append(np.frombuffer(token, np.uint64) if key >= buckets else words.unpack(token))
            owners.append(np.frombuffer(owner, "<u2").astype(np.uint32) + np.uint32(base))
            base += len(node)
        node, first, at = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first]
        token, owner = np.concatenate(tokens), at[np.concatenate(owners)].astype(np.uint32)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.ones(len(token), bool)  # the same node can come from several batches
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[fresh], owner[fresh]
        if key >= buckets:
            rank = np.full(len(token), 255, np.uint8)
        else:
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(token)))
            rank = np.repeat(np.minimum(254, np.rint(8 * np.log2(count))).astype(np.uint8), count)
            keep = rank > 0
            token, owner, rank = token[keep], owner[keep], rank[keep]
        out = []
        order = np.lexsort((token, owner, node[owner] % np.uint64(parts)))
        token, owner, rank = token[order], owner[order], rank[order]
        part = (node[owner] % np.uint64(parts)).astype(np.int64)
        for i, j in _runs(part):
            own, count = np.unique(owner[i:j], return_counts=True)
            out.append((int(part[i]), node[own].tobytes(), size[own].tobytes(), count.astype(np.uint32).tobytes(), token[i:j].tobytes(), rank[i:j].tobytes()))
        return pa.Table.from_batches(list(_emit(out, SHARED)), schema=_schema(SHARED))

    return run


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in text.split(", ")])


def _groups(n: int) -> int:
    return 1 << max(0, (n // GROUP_TOKENS).bit_length() - 1)


def signatures(n: int, tokens: np.ndarray, ranks: np.ndarray, percent: int, smaller: bool = False) -> np.ndarray:
    """Signatures of a set of n tokens, given those of its tokens that other nodes have too. Empty: it has no partner.

    smaller: those it needs for partners of its size or more, with which it shares 2t / (1 + t) of its tokens.
    """
    least = -(-2 * percent * n // (100 + percent)) if smaller else least_overlap(n, percent)
    need = n - least + 1 - (n - len(tokens))
    if need <= 0 or n < 2:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, ranks))
    tokens, rare = tokens[order], ranks[order] < 8 * math.log2(FREQUENT)
    n_rare = int(rare.sum())
    out = [words.mix(tokens[: min(need, n_rare)])]
    if n_rare < need:
        often = tokens[n_rare:]
        # The partner of a pair may be larger by 1/t, so by one step of the number of groups at most.
        for groups in {_groups(n), _groups(100 * n // percent)}:
            group = (words.mix(often) % np.uint64(groups)).astype(np.int64)
            # 1 for each token but the first of its group
            seen = np.ones(len(often), np.int64)
            seen[np.unique(group, return_index=True)[1]] = 0
            weight = n_rare + np.cumsum(seen)
            end = int(np.searchsorted(weight, need)) + 1
            own, by = often[:end], group[:end]
            order = np.argsort(by, kind="stable")
            own, by = own[order], by[order]
            bounds = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1], [True])))
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j - i > 1:
                    a, b = np.triu_indices(j - i, 1)
                    x, y = np.sort(np.stack((own[i:j][a], own[i:j][b])), axis=0)
                    out.append(words.mix(words.mix(x * np.uint64(3) + np.uint64(groups)) + y * np.uint64(0x9E3779B97F4A7C15)))
    return words.distinct(np.concatenate(out))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Of each of 64 * SKETCH classes of tokens whether the set has an odd number. Two sketches differ in as many bits
    as the sets differ in tokens at most."""
    odd = np.bincount((words.mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fits(percent: int):
    """Whether the sketches of a and b allow the similarity: overlap <= (tokens of both - differing bits) / 2."""
    differ = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(SKETCH)), F.lit(0))
    return (F.col("ma") + F.col("mb") - differ) * (100 + percent) >= (F.col("na") + F.col("nb")) * (2 * percent)


def _index(percent: int):
    """Of one part of the nodes: the shared tokens of each that may have a partner, and its signatures."""

    def run(key, table):
        nodes, sizes, tokens, ranks = [], [], [], []
        for node, size, count, token, rank in zip(*(table.column(c).to_pylist() for c in ("nodes", "sizes", "counts", "tokens", "ranks")), strict=True):
            count = np.frombuffer(count, np.uint32)
            nodes.append(np.repeat(np.frombuffer(node, np.uint64), count))
            sizes.append(np.repeat(np.frombuffer(size, np.uint32), count))
            tokens.append(np.frombuffer(token, np.uint64))
            ranks.append(np.frombuffer(rank, np.uint8))
        node, size, token, rank = map(np.concatenate, (nodes, sizes, tokens, ranks))
        order = np.lexsort((token, node))
        node, size, token, rank = node[order], size[order], token[order], rank[order]
        bounds = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        sigs, leads, owners, counts, cores, full = [], [], [], [], [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = int(size[i])
            own = signatures(n, token[i:j], rank[i:j], percent)
            if len(own):
                sigs.append(own)
                leads.append(np.isin(own, signatures(n, token[i:j], rank[i:j], percent, smaller=True)))
                owners.append(np.full(len(own), node[i], np.uint64))
                counts.append(np.full(len(own), n, np.int64))
                cores.append(np.full(len(own), int(rank[i:j].sum(dtype=np.int64)) // n, np.int32))
                full.append((None, int(node[i : i + 1].view(np.int64)[0]), n, None, None, token[i:j].tobytes(), j - i, sketch(token[i:j])))
        if not full:
            return pa.Table.from_batches([], schema=_schema(INDEX))
        sig = np.concatenate(sigs)
        sigs = pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.concatenate(owners).view(np.int64)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(cores)), pa.array(np.concatenate(leads)), pa.nulls(len(sig), pa.binary()), pa.nulls(len(sig), pa.int32()), pa.nulls(len(sig), pa.list_(pa.int64()))], schema=_schema(INDEX))
        return pa.Table.from_batches([sigs, *_emit(full, INDEX)])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            a_ids, b_ids, na, nb, ta, tb = (batch.column(i) for i in range(6))
            for i, (x, y) in enumerate(zip(na.to_pylist(), nb.to_pylist(), strict=True)):
                # memory of the Arrow batch, without a copy
                p, q = (np.frombuffer(t[i].as_buffer(), np.uint64) for t in (ta, tb))
                both = np.concatenate((p, q))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (x + y - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a_ids.take(pa.array(keep, pa.int64())), b_ids.take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that are similar enough. The sets are joined to them, never gathered."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return both.mapInArrow(words.freeing(_verify(percent)), "a long, b long")


def _pieces():
    return F.ceil(F.col("m") / F.lit(PIECE)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    """Nodes of a bucket of m, dealt to its pieces."""
    return df.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), _pieces()).cast("int"))


def _copies(df: DataFrame) -> DataFrame:
    """A row for each piece of its bucket."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), _pieces() - 1)))


def _stars(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """A few candidate pairs for each node: with hubs of its buckets that lie in other components.

    The hubs of a bucket and band of sizes (sizes within the similarity) are its first nodes in orders by core (the
    mean log frequency of a node's tokens: a copy with few changes of its own is like most others) and more or less
    chance, which changes with ``turn``. A node keeps the first hub of each order: its pairs are as many as the orders.
    """
    banded = _salted(placed).withColumn("band", F.floor(F.log("n") / F.lit(math.log(100 / percent))))
    chance = [F.pmod(F.xxhash64("node", F.lit(turn), F.lit(j)), F.lit(1 << 20)) / F.lit(1 << 20) for j in range(len(HUB_CHANCE))]
    orders = [F.lit(float(much)) * x - F.col("core") for much, x in zip(HUB_CHANCE, chance, strict=True)]
    hubs = banded.groupBy("sig", "band").agg(F.max("m").alias("m"), *[F.min(F.struct(o.alias("o"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))).alias(f"hub{j}") for j, o in enumerate(orders)])
    near = banded.join(_copies(hubs).drop("m"), ["sig", "band", "salt"])

    def fits(j: int):
        small, large = F.least(f"hub{j}.na", "n"), F.greatest(f"hub{j}.na", "n")
        return (F.col(f"hub{j}.ca") != F.col("comp")) & (small * 100 >= large * percent)

    first = near.groupBy(F.col("node").alias("b")).agg(*[F.min(F.when(fits(j), F.struct(f"hub{j}.o", f"hub{j}.a"))).alias(f"hub{j}") for j in range(len(orders))])
    hubs_of = F.array_distinct(F.array_compact(F.array(*[F.col(f"hub{j}.a") for j in range(len(orders))])))
    return first.select("b", F.explode(hubs_of).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _drop(spark: SparkSession, *tables) -> None:
    for table in tables:
        if table is not None:
            drop_cut(table)
    collect_garbage(spark)


def _near(percent: int):
    """Sizes that allow the similarity."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return small * 100 >= large * percent


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, key_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; other columns are not looked at. key_col: a long column
    that is returned as ``key``, with a number for each component as ``group`` (null without words).

    Null, empty and blank texts: 0 shingles, linked with nothing, component_id is the row's own id. Texts of fewer than
    ``size`` words are one shingle. Rows with equal sets are linked, repeated rows too, and each is returned. A null id
    never is a component's id unless all ids of the component are null. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(key_col) if key_col else F.lit(None)).cast("long").alias("key"))
    found = cut(source.mapInArrow(words.freeing(_rows(size)), ROWS))
    rows = found.filter("kind = 0").select("doc_id", "n", "node", *(["key"] if key_col else []))
    more = lambda group: ["key", group.cast("long").alias("group")] if key_col else []
    n_rows, n_tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_rows:
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more(F.lit(None)))
    common = found.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("c")).filter(F.col("c") >= F.lit(max(COMMON_LEAST, COMMON / 4 * n_rows))).orderBy(F.desc("c"), "node").limit(MOST_COMMON).select("node")
    common = np.sort(np.array([r[0] for r in common.toLocalIterator()], np.int64).view(np.uint64))
    buckets = 1 << max(4, math.ceil(math.log2(max(1, n_tokens / BUCKET_TOKENS))))
    parts = buckets
    postings = source.mapInArrow(words.freeing(_postings(size, buckets, parts, spark.sparkContext.broadcast(common))), POSTINGS)
    shared = postings.groupBy("key").applyInArrow(_answers(buckets, parts), SHARED)
    index = cut(shared.groupBy("part").applyInArrow(_index(percent), INDEX))
    sets = index.filter("sig is null").select("node", "n", "tokens")
    sigs = index.filter("sig is not null").select("sig", "node", "n", "core", "lead")
    # A signature of one node makes no pair, and of those with the very same nodes (a shared passage) one is enough.
    # It must be a short-prefix signature of one of them: of the smaller set of a similar pair it is.
    h = F.xxhash64("node", "lead")
    members = sigs.groupBy("sig").agg(F.count("*").alias("m"), F.sum(h.bitwiseAND(0x7FFFFFFFFFFF)).alias("s"), F.bit_xor(h).alias("x"), F.bool_or("lead").alias("led"))
    sigs = cut(sigs.join(members.filter("m > 1 and led").groupBy("m", "s", "x").agg(F.min("sig").alias("sig")).select("sig", "m"), "sig"))

    links, labels, active = None, None, sigs.withColumn("comp", F.col("node"))
    for turn in range(STAR_ROUNDS):
        linked = _links(_stars(active, turn, percent), sets, percent)
        step = cut(linked if links is None else links.unionByName(linked))
        _drop(spark, links, labels)
        links, labels = step, components(step)
        placed = sigs.join(labels, "node", "left").select("sig", "node", "n", "core", "lead", "m", F.coalesce("comp", "node").alias("comp"))
        apart = placed.groupBy("sig").agg(F.max("m").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        fresh = cut(_salted(placed).join(_copies(apart).select("sig", "salt"), ["sig", "salt"]).drop("salt"))
        _drop(spark, active)
        active = fresh

    # Whatever still lies in different components of one bucket: nodes outside its largest component against all.
    largest = active.groupBy("sig", "comp").agg(F.count("*").alias("c"), F.max("m").alias("m")).groupBy("sig").agg(F.max("m").alias("m"), F.max(F.struct("c", "comp")).alias("most")).select("sig", "m", F.col("most.comp").alias("largest"))
    whole = active.join(index.filter("sig is null").select("node", "shared", "sketch"), "node")
    outer = _salted(active).join(_copies(largest).drop("m"), ["sig", "salt"]).drop("salt").filter("comp != largest")
    outer = _copies(outer).join(index.filter("sig is null").select("node", "shared", "sketch"), "node")
    one = outer.select("sig", "salt", "largest", F.col("lead").alias("la"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("shared").alias("ma"), F.col("sketch").alias("sa"))
    other = _salted(whole).select("sig", "salt", F.col("lead").alias("lb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("shared").alias("mb"), F.col("sketch").alias("sb"))
    first = F.struct("na", "a") < F.struct("nb", "b")
    # the smaller set leads; of two outer nodes the pair is listed once
    wanted = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("largest")) | first) & F.when(first, F.col("la")).otherwise(F.col("lb")) & _near(percent)
    pairs = one.join(other, ["sig", "salt"]).filter(wanted & _fits(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    last = cut(links.unionByName(_links(pairs, sets, percent)))
    _drop(spark, links, labels)
    labels = components(last)
    _drop(spark, last, index, sigs, active)

    # Rows meet once a set, sets once a component; then a component's id goes back to its sets, and theirs to the rows.
    full = rows.filter("n > 0")
    of_set = full.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("m")).join(labels, "node", "left")
    of_set = cut(of_set.withColumn("comp", F.coalesce("comp", "node")))
    of_comp = cut(of_set.groupBy("comp").agg(F.min("low").alias("component_id"), F.count("*").alias("m")))
    named = cut(skew.join_groups(of_set.withColumnRenamed("m", "copies").drop("low"), of_comp, "comp", n_rows).withColumnRenamed("copies", "m"))
    _drop(spark, labels, of_set, of_comp)
    full = skew.join_groups(full, named, "node", n_rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more(F.col("comp")))
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more(F.lit(None)))
    return full.unionByName(empty)

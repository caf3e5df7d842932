"""Sequences in chunks, k-mer postings, and searches on them. Tables: (id, chunk_id, chunk_start, seq)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.functions import sequences as S

CHUNK = 2000
#: Symbols, and rows, that a worker looks at in one go.
BLOCK = 1 << 20
ROWS = 1 << 14


def chunk(df: DataFrame, id_col: str, seq_col: str = "seq", size: int = CHUNK, overlap: int = 0) -> DataFrame:
    """Chunks of ``size`` symbols, each with the next ``overlap`` symbols: windows up to overlap + 1 start in one chunk."""
    # one pass over the sequence; a chunk is not cut out by counting symbols from the sequence's start
    found = F.regexp_extract_all(F.col(seq_col), F.lit(f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))
    pieces = F.when(F.length(seq_col) > 0, found).otherwise(F.array(F.col(seq_col)))
    out = df.select(id_col, F.posexplode(pieces).alias("chunk_id", "seq"))
    return out.select(id_col, F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("chunk_id").cast("long") * size).alias("chunk_start"), "seq")


def fetch(chunks: DataFrame, id_col: str, start: int, end: int, size: int = CHUNK) -> DataFrame:
    """(id, seq) of [start, end): only chunks that it touches are read."""
    if start > end:
        raise ValueError(f"{start} > {end}")
    touched = chunks.filter(F.col("chunk_id").between(start // size, max(start, end - 1) // size))
    lo, hi = F.greatest(F.lit(start) - F.col("chunk_start"), F.lit(0)), F.least(F.lit(end) - F.col("chunk_start"), F.lit(size))
    part = F.substring(F.substring(F.col("seq"), F.lit(1), F.lit(size)), (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    parts = touched.select(id_col, F.struct("chunk_id", part.alias("s")).alias("p"))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))


def fetch_full(chunks: DataFrame, id_col: str, size: int = CHUNK) -> DataFrame:
    parts = chunks.select(id_col, F.struct("chunk_id", F.substring("seq", 1, size).alias("s")).alias("p"))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["s"]), "").alias("seq"))


class _Block:
    """Pieces of some rows' sequences, one after the other: ``at(j)`` is the j-th symbol of every window of ``width``.
    like: the same windows' reverse complements.

    A window belongs to the piece where it starts; those that begin in one piece and end in another are none.
    """

    def __init__(self, keys, pieces, width, like=None):
        import numpy as np

        self.keys, self.width, self.turned = keys, width, like is not None
        if like is not None:
            self.symbols = _mapped(like.symbols, S.ALPHABET, S.COMPLEMENT)
            return
        self.rows, self.froms = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
        self.lengths = np.array([len(p[2]) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.symbols = np.concatenate([p[2] for p in pieces])

    def at(self, j):
        j = self.width - 1 - j if self.turned else j
        return self.symbols[j : j + len(self.symbols) - self.width + 1]

    def whole(self, hits):
        """Which of these windows lie within one piece, and the number of the piece."""
        import numpy as np

        piece = np.searchsorted(self.starts, hits, "right") - 1
        return hits - self.starts[piece] + self.width <= self.lengths[piece], piece

    def texts(self, hits):
        """The symbols of windows, as an array of strings."""
        import numpy as np
        import pyarrow as pa

        windows = np.lib.stride_tricks.sliding_window_view(self.symbols, self.width)[hits]
        windows = windows[:, ::-1] if self.turned else windows
        if self.symbols.dtype == np.uint8:
            return _strings(windows)
        return pa.array([w.tobytes().decode("utf-32-le") for w in windows], pa.string())


def _strings(octets):
    """Rows of ASCII codes as strings."""
    import numpy as np
    import pyarrow as pa

    n, width = octets.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(octets)))


def _symbols(text: str):
    """Code points, in bytes where all are ASCII."""
    import numpy as np

    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mapped(symbols, source: str, target: str, other: str | None = None):
    """Symbols by a table from one string to another; what it lacks stays, or becomes ``other``."""
    import numpy as np

    table = np.arange(256, dtype=symbols.dtype) if other is None else np.full(256, ord(other), symbols.dtype)
    table[[ord(c) for c in source]] = [ord(c) for c in target]
    if symbols.dtype == np.uint8:
        return table[symbols]
    return np.where(symbols < 256, table[np.minimum(symbols, 255)], symbols if other is None else ord(other)).astype(symbols.dtype)


def _pieces(batch, width: int, size: int, bases: bool = False, pad: int = 0):
    """(row, from, symbols) of the sequences in the last column, each with the next width - 1 symbols. bases: symbols
    outside ACGT are read as A; pad: so many zeros follow the sequence."""
    import numpy as np

    texts = batch.column(batch.num_columns - 1)
    for row in range(batch.num_rows):
        text = texts[row].as_py()
        if text is not None and len(text) + pad >= width:
            symbols = _symbols(text)
            symbols = _mapped(symbols, "ACGT", "ACGT", "A") if bases else symbols
            symbols = np.concatenate((symbols, np.zeros(pad, symbols.dtype))) if pad else symbols
            for start in range(0, len(symbols) - width + 1, size):
                yield row, start, symbols[start : start + size + width - 1]


def _blocks(batches, width: int, bases: bool = False, pad: int = 0):
    size = max(1 << 12, min(BLOCK, (BLOCK << 4) // width))
    for batch in batches:
        held, n = [], 0
        for piece in _pieces(batch, width, size, bases, pad):
            held.append(piece)
            n += len(piece[2])
            if n >= size or len(held) >= ROWS:
                yield _Block(batch, held, width)
                held, n = [], 0
        if held:
            yield _Block(batch, held, width)


def scan(df: DataFrame, keys: list[str], seq: Column, width: int, visit, fields: str, bases: bool = False) -> DataFrame:
    """(keys, pos, fields) of windows of ``width`` of a sequence.

    visit: a function of a block that gives the windows that it wants, by number, and their fields as arrays. A worker
    asks for all windows of a block at once, so the time is in proportion to the symbols; only what is wanted becomes rows.
    bases: symbols outside ACGT are read as A.
    """
    rows = df.select(*keys, seq.alias("__seq"))
    extra = T.StructType.fromDDL(fields) if fields else T.StructType()
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("pos", T.LongType()), *extra])
    names = schema.names

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks(batches, width, bases):
            hits, columns = visit(block)
            ok, piece = block.whole(hits)
            if not ok.any():
                continue
            piece, kept = piece[ok], np.flatnonzero(ok)
            pos = hits[ok] - block.starts[piece] + block.froms[piece]
            row = pa.array(block.rows[piece])
            columns = [c.take(pa.array(kept)) if isinstance(c, pa.Array) else pa.array(c[kept]) for c in columns]
            yield pa.RecordBatch.from_arrays([*(block.keys.column(i).take(row) for i in range(len(keys))), pa.array(pos), *columns], names)

    return rows.mapInArrow(run, schema)


def _differences(block, pattern: str, hits=None):
    """Mismatches of windows with a pattern that is not longer than they are."""
    import numpy as np

    n = len(block.symbols) - block.width + 1 if hits is None else len(hits)
    total = np.zeros(n, np.uint8 if len(pattern) < 256 else np.int32)
    for j, c in enumerate(pattern):
        here = block.at(j) if hits is None else block.at(j)[hits]
        total += here != ord(c)
    return total


def postings(df: DataFrame, id_col: str, k: int, seq_col: str = "seq", among: str | None = None) -> DataFrame:
    """(id, pos, kmer) of every window, U read as T. among: only of windows that occur in this query."""
    own = None if among is None else sorted(set(query_kmers(among, k)))

    def visit(block):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(block.symbols) - k + 1
        if own is None:
            hits = np.arange(n)
            return hits, [block.texts(hits)]
        # by a hash of the windows first, then by their symbols
        mix = lambda symbol: functools.reduce(lambda h, j: h * np.uint64(0x9E3779B97F4A7C15) + symbol(j).astype(np.uint64), range(k), np.uint64(0))
        wanted = np.array([list(map(ord, x)) for x in own], np.uint64).reshape(len(own), k)
        told = np.sort(np.atleast_1d(mix(lambda j: wanted[:, j])))
        code = mix(block.at)
        hits = np.flatnonzero(told[np.minimum(np.searchsorted(told, code), len(told) - 1)] == code) if own else np.arange(0)
        texts = block.texts(hits)
        same = pc.is_in(texts, value_set=pa.array(own, pa.string())).to_numpy(zero_copy_only=False)
        return hits[same], [texts.take(pa.array(np.flatnonzero(same)))]

    return scan(df, [id_col], S.dna(F.col(seq_col)), k, visit, "kmer string")


def query_kmers(query: str, k: int) -> list[str]:
    query = query.upper().replace("U", "T")
    return [query[i : i + k] for i in range(len(query) - k + 1)]


def jaccard(index: DataFrame, id_col: str, query: str, k: int) -> DataFrame:
    """(id, jaccard) of distinct k-mers, of the ids that have k-mers; 0 for a query shorter than k."""
    own = sorted(set(query_kmers(query, k)))
    if not own:
        return index.select(id_col).distinct().withColumn("jaccard", F.lit(0.0))
    # partial aggregation per (id, kmer) first, then two counts per id
    sets = index.select(id_col, "kmer").distinct()
    hit = F.count(F.when(F.col("kmer").isin(own), 1))
    return sets.groupBy(id_col).agg((hit / (F.count("*") + len(own) - hit)).alias("jaccard"))


def _distinct(batches, k: int):
    """(id, k-mers, their counts, which of them are new to the id) of sequences that come in order of their ids.

    K-mers are numbers of their ASCII codes, in order; those with other symbols are strings.
    """
    import collections

    import numpy as np

    last, seen, others = object(), np.empty(0, np.uint64), set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for row, start, symbols in _pieces(batch, k, BLOCK):
            if type(ids[row]) is not type(last) or ids[row] != last:
                last, seen, others = ids[row], np.empty(0, np.uint64), set()
            n = len(symbols) - k + 1
            code = np.zeros(n, np.uint64)
            for j in range(k):
                code <<= np.uint64(8)
                code |= symbols[j : j + n].astype(np.uint64)
            if symbols.dtype != np.uint8:
                plain = np.lib.stride_tricks.sliding_window_view(symbols < 128, k).all(axis=1)
                rest = collections.Counter(symbols[i : i + k].tobytes().decode("utf-32-le") for i in np.flatnonzero(~plain))
                yield row, batch, list(rest), np.array(list(rest.values()), np.int64), np.array([x not in others for x in rest], bool)
                others |= set(rest)
                code = code[plain]
            code, count = np.unique(code, return_counts=True)
            new = ~np.isin(code, seen) if len(seen) else np.ones(len(code), bool)
            yield row, batch, code, count, new
            seen = np.union1d(seen, code) if len(seen) else code


def _grouped(df: DataFrame, id_col: str, seq: Column) -> DataFrame:
    """(id, seq), the rows of an id together in one task."""
    n = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    return df.select(id_col, seq.alias("__seq")).repartition(n, id_col).sortWithinPartitions(id_col)


def kmer_counts(df: DataFrame, id_col: str, k: int, seq_col: str = "seq") -> DataFrame:
    """(kmer, n, docs): windows of each k-mer, U read as T, and the ids that have it. They are counted where the sequences
    are, so what is shuffled are sums of up to four million k-mers."""
    if k > 8:
        return postings(df, id_col, k, seq_col).groupBy("kmer").agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("docs"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def summed(held):
            code, n, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            return code[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)

        def out(held):
            code, n, docs = summed(held)
            texts = _strings(code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - k :])
            return pa.RecordBatch.from_arrays([texts, pa.array(n), pa.array(docs)], ["kmer", "n", "docs"])

        held, size = [], 0
        for row, batch, code, count, new in _distinct(batches, k):
            known = batch.column(0)[row].is_valid
            docs = (new & known).astype(np.int64)
            if isinstance(code, list):
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.string()), pa.array(count), pa.array(docs)], ["kmer", "n", "docs"])
                continue
            held.append((code, count, docs))
            size += len(code)
            if size >= 4 * BLOCK:
                held = [summed(held)]
                size = len(held[0][0])
                if size >= 2 * BLOCK:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    parts = _grouped(df, id_col, S.dna(F.col(seq_col))).mapInArrow(run, "kmer string, n long, docs long")
    return parts.groupBy("kmer").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def jaccard_of(df: DataFrame, id_col: str, query: str, k: int, seq_col: str = "seq") -> DataFrame:
    """``jaccard`` of sequences instead of an index: distinct k-mers are counted where the sequences are."""
    own = sorted(set(query_kmers(query, k)))
    if k > 8 or not own or not all(x.isascii() for x in own):
        return jaccard(postings(df, id_col, k, seq_col), id_col, query, k)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codes = np.array([int.from_bytes(x.encode(), "big") for x in own], np.uint64)
        for row, batch, code, _, new in _distinct(batches, k):
            hit = 0 if isinstance(code, list) else np.count_nonzero(np.isin(code[new], codes))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([np.count_nonzero(new)], pa.int64()), pa.array([hit], pa.int64())], [id_col, "n", "hit"])

    rows = _grouped(df, id_col, S.dna(F.col(seq_col)))
    counts = rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("n", T.LongType()), T.StructField("hit", T.LongType())]))
    sums = counts.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    return sums.select(id_col, (F.col("hit") / (F.col("n") + len(own) - F.col("hit"))).alias("jaccard"))


def jaccard_whole(index: DataFrame, query: str, k: int) -> DataFrame:
    """One row (jaccard): the query against all k-mers of the index as one set; 0 where the union is empty."""
    own = sorted(set(query_kmers(query, k)))
    hit = F.count(F.when(F.col("kmer").isin(own), 1)) if own else F.lit(0)
    counts = index.select("kmer").distinct().agg(F.count("*").alias("n"), hit.alias("hit"))
    return counts.select(F.coalesce(F.try_divide(F.col("hit"), F.col("n") + len(own) - F.col("hit")), F.lit(0.0)).alias("jaccard"))


def lookup(index: DataFrame, kmer: str) -> DataFrame:
    """(id, pos) of one k-mer, in order; U is read as T."""
    return index.filter(F.col("kmer") == kmer.upper().replace("U", "T")).drop("kmer").orderBy(*[c for c in index.columns if c != "kmer"])


def shared_positions(index: DataFrame, id_col: str, query: str, k: int) -> DataFrame:
    """(id, shared): positions of the query whose k-mer the sequence has."""
    own = query_kmers(query, k)
    spark = index.sparkSession
    q = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "qpos int, kmer string")
    held = index.filter(F.col("kmer").isin(own))  # before anything is made distinct
    return held.select(id_col, "kmer").distinct().join(F.broadcast(q), "kmer").groupBy(id_col).agg(F.count("*").alias("shared"))


def window_density(index: DataFrame, id_col: str, query: str, k: int, width: int = 100, least: int = 1) -> DataFrame:
    """(id, window, hits): k-mer hits by window of ``width``, most first."""
    spark = index.sparkSession
    q = spark.createDataFrame([(x,) for x in query_kmers(query, k)], "kmer string")
    hits = index.join(F.broadcast(q), "kmer").groupBy(id_col, (F.floor(F.col("pos") / width) * width).alias("window")).agg(F.count("*").alias("hits"))
    return hits.filter(F.col("hits") >= least).orderBy(F.desc("hits"), id_col, "window")


def locate_exact(df: DataFrame, id_col: str, pattern: str, seq_col: str = "seq") -> DataFrame:
    """(id, pos) of overlapping occurrences; symbols outside ACGTU of the text count as A, in a pattern give nothing."""
    text = df.select(id_col, S.dna(F.col(seq_col)).alias("seq"))
    pattern = pattern.upper().replace("U", "T")
    if not pattern or set(pattern) - set("ACGT"):
        return text.select(id_col, F.lit(0).cast("long").alias("pos")).limit(0)

    def visit(block):
        import numpy as np

        return np.flatnonzero(_differences(block, pattern) == 0), []

    return scan(text, [id_col], F.col("seq"), len(pattern), visit, "", bases=True)


def count_exact(df: DataFrame, id_col: str, pattern: str, seq_col: str = "seq") -> DataFrame:
    """(id, n) of overlapping occurrences, of the ids that have any."""
    return locate_exact(df, id_col, pattern, seq_col).groupBy(id_col).agg(F.count("*").alias("n"))


def suffix_interval(df: DataFrame, id_col: str, pattern: str, seq_col: str = "seq") -> DataFrame:
    """(id, low, high): where suffixes that begin with the pattern stand among all sorted suffixes, the end mark's first.

    This is what backward search in a full-text index finds; here suffixes below and at the pattern are counted in one
    scan, by their first symbols. Ids without an occurrence, empty patterns and other symbols than ACGTU give nothing.
    """
    text = df.select(id_col, S.dna(F.col(seq_col)).alias("seq"))
    pattern = pattern.upper().replace("U", "T")
    if not pattern or set(pattern) - set("ACGT"):
        return text.select(id_col, F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).limit(0)
    m = len(pattern)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks(batches, m, bases=True, pad=m - 1):  # a short suffix is below what it begins
            below, same = (np.full(len(block.symbols) - m + 1, x) for x in (False, True))
            for j, c in enumerate(pattern):
                below |= same & (block.at(j) < ord(c))
                same &= block.at(j) == ord(c)
            count = lambda mask: np.bincount(piece[mask[hits]], minlength=len(block.rows)).astype(np.int64)  # noqa: E731, B023
            hits = np.flatnonzero(below | same)
            ok, piece = block.whole(hits)
            hits, piece = hits[ok], piece[ok]
            yield pa.RecordBatch.from_arrays([block.keys.column(0).take(pa.array(block.rows)), pa.array(count(below)), pa.array(count(same))], [id_col, "below", "n"])

    counts = text.mapInArrow(run, T.StructType([text.schema[id_col], T.StructField("below", T.LongType()), T.StructField("n", T.LongType())]))
    rows = counts.groupBy(id_col).agg(F.sum("below").alias("below"), F.sum("n").alias("n"))
    return rows.filter("n > 0").select(id_col, (F.col("below") + 1).alias("low"), (F.col("below") + 1 + F.col("n")).alias("high"))


def _suffix_order(symbols):
    """Places of the suffixes in order, by doubling the length of the sorted prefixes."""
    import numpy as np

    rank, n, width = symbols.astype(np.int64), len(symbols), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(n - width, 0)] = rank[width:]
        order = np.lexsort((second, rank))
        pair = np.stack((rank[order], second[order]))
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum((pair[:, 1:] != pair[:, :-1]).any(axis=0)))) if n else []
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


def bwt(df: DataFrame, id_col: str, seq_col: str = "seq") -> DataFrame:
    """(id, bwt): the Burrows-Wheeler text of each sequence with ``$`` as its end mark; symbols outside ACGTU count as A.

    Each sequence is sorted in one task, with about 60 bytes a symbol: for sequences up to a chromosome's arm.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(df.dtypes)[id_col]
    text = df.select(id_col, F.regexp_replace(S.dna(F.col(seq_col)), "[^ACGT]", "A").alias("seq"))

    def run(batches):
        for batch in batches:
            out = []
            for seq in batch.column(1).to_pylist():
                symbols = np.frombuffer(f"{seq or ''}$".encode(), np.uint8)
                out.append(symbols[_suffix_order(symbols) - 1].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "bwt"])

    return text.mapInArrow(run, f"`{id_col}` {kind}, bwt string")


def locate_approximate(df: DataFrame, id_col: str, pattern: str, mismatches: int, seq_col: str = "seq") -> DataFrame:
    """(id, pos, mismatches) with at most so many substitutions: every window is compared."""
    text = df.select(id_col, S.dna(F.col(seq_col)).alias("seq"))
    pattern = pattern.upper().replace("U", "T")
    if not pattern or set(pattern) - set("ACGT"):
        return text.select(id_col, F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("mismatches")).limit(0)

    def visit(block):
        import numpy as np

        found = _differences(block, pattern)
        hits = np.flatnonzero(found <= mismatches)
        return hits, [found[hits].astype(np.int64)]

    return scan(text, [id_col], F.col("seq"), len(pattern), visit, "mismatches long", bases=True)


def pam_sites(df: DataFrame, id_col: str, guide: str, mismatches: int, seq_col: str = "seq", weights: DataFrame | None = None) -> DataFrame:
    """(id, strand, pos, protospacer, pam, mismatches, score) of off-target sites beside NGG or NAG, on both strands.

    pos is the 0-based start of the PAM on its strand; on the reverse strand length - it. The score is 100 for each kept
    site, times 0.25 for NAG, or times the product of ``weights`` (position, rna, dna, weight) if given.
    """
    g = len(guide)
    guide = guide.upper().replace("U", "T")
    if not g:
        raise ValueError("an empty guide")

    def visit(block):
        import numpy as np
        import pyarrow as pa

        other = _Block(block.keys, [], block.width, like=block)  # each window's reverse complement
        out = []
        for strand, b in (("+", block), ("-", other)):
            hits = np.flatnonzero(((b.at(g + 1) == ord("G")) | (b.at(g + 1) == ord("A"))) & (b.at(g + 2) == ord("G")))
            found = _differences(b, guide, hits)
            few = found <= mismatches
            out.append((hits[few], pa.array([strand] * np.count_nonzero(few), pa.string()), b.texts(hits[few]), found[few].astype(np.int64)))
        hits, strand, texts, found = zip(*out, strict=True)
        return np.concatenate(hits), [pa.concat_arrays(strand), pa.concat_arrays(texts), np.concatenate(found)]

    w = scan(df, [id_col], S.dna(F.col(seq_col)), g + 3, visit, "strand string, kmer string, mismatches long")
    site = w.select(id_col, "strand", "pos", F.substring("kmer", 1, g).alias("protospacer"), F.substring("kmer", g + 1, 3).alias("pam"), "mismatches")
    score = 100.0 * F.when(F.substring("pam", 2, 1) == "G", 1.0).otherwise(0.25)
    if weights is not None:
        w = {(r.position, r.dna): r.weight for r in weights.collect() if r.rna.upper().replace("U", "T") == guide[r.position]}  # at most 3 rows a position
        for i in range(g):
            factor = F.lit(1.0)
            for (p, base), x in w.items():
                if p == i:
                    factor = F.when(F.substring("protospacer", i + 1, 1) == base, x).otherwise(factor)
            score = score * factor
    # on the reverse strand the PAM ends where the window starts: the place after it, from the sequence's start, is told
    return site.select(id_col, "strand", (F.col("pos") + F.when(F.col("strand") == "+", g).otherwise(3)).alias("pos"), "protospacer", "pam", "mismatches", score.alias("score"))


def offtarget_report(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: exact, total_bp, burden (all scores but the first exact site's), specificity."""
    best = F.max(F.when(F.col("mismatches") == 0, F.col("score")))
    agg = sites.agg(F.count_if(F.col("mismatches") == 0).alias("exact"), F.count("*").alias("hits"), (F.coalesce(F.sum("score"), F.lit(0.0)) - F.coalesce(best, F.lit(0.0))).alias("burden"))
    total = lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bp"))
    return agg.join(F.broadcast(total)).withColumn("specificity", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 10000.0 / (100.0 + F.col("burden")))))


def audit_guides(df: DataFrame, id_col: str, guides: list[str], mismatches: int, seq_col: str = "seq") -> DataFrame:
    """(guide, exact, hits, burden, specificity, offtarget_score) of each guide: ``offtarget_report`` of all of them.

    offtarget_score: 100 - specificity, but 1 at least and 50 at most. A guide without sites has a row too.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(x,) for x in dict.fromkeys(guides)], "guide string")
    found = functools.reduce(DataFrame.unionByName, (pam_sites(df, id_col, x, mismatches, seq_col).select(F.lit(x).alias("guide"), "mismatches", "score") for x in dict.fromkeys(guides)))
    best = F.max(F.when(F.col("mismatches") == 0, F.col("score")))
    sums = found.groupBy("guide").agg(F.count_if(F.col("mismatches") == 0).alias("exact"), F.count("*").alias("hits"), (F.sum("score") - F.coalesce(best, F.lit(0.0))).alias("burden"))
    rows = names.join(sums, "guide", "left").select("guide", *(F.coalesce(c, F.lit(z)).alias(c) for c, z in (("exact", 0), ("hits", 0), ("burden", 0.0))))
    rows = rows.withColumn("specificity", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 10000.0 / (100.0 + F.col("burden")))))
    return rows.withColumn("offtarget_score", F.least(F.lit(50.0), F.greatest(F.lit(1.0), 100.0 - F.col("specificity"))))


def pwm_scan(df: DataFrame, id_col: str, matrix: list[dict[str, float]], threshold: float, seq_col: str = "seq") -> DataFrame:
    """(id, pos, score): windows whose summed log-odds reach ``threshold``; other symbols score 0."""

    def visit(block):
        import numpy as np

        score = np.zeros(len(block.symbols) - block.width + 1)
        for j, column in enumerate(matrix):
            part = np.zeros(len(score))
            for base, x in column.items():
                if len(base) == 1:
                    part[block.at(j) == ord(base)] = x
            score += part
        hits = np.flatnonzero(score >= threshold)
        return hits, [score[hits]]

    return scan(df, [id_col], S.dna(F.col(seq_col)), len(matrix), visit, "score double")


def cpg_islands(df: DataFrame, id_col: str, seq_col: str = "seq", width: int = 200, step: int = 50, gc: float = 0.5, ratio: float = 0.6) -> DataFrame:
    """(id, start, end, n): merged windows with GC and observed / expected CpG of at least gc and ratio."""
    from strandframe.operators.intervals import merge_islands

    text = df.select(id_col, S.dna(F.col(seq_col)).alias("seq")).filter(F.length("seq") >= width)
    starts = F.sequence(F.lit(0), F.length("seq") - width, F.lit(step))
    w = text.select(id_col, F.explode(F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.substring(F.col("seq"), i + 1, F.lit(width)).alias("w")))).alias("x")).select(id_col, "x.*")
    count = lambda p: F.regexp_count("w", F.lit(p))
    w = w.select(id_col, "start", count("C").alias("c"), count("G").alias("g"), count("CG").alias("cg"))
    kept = w.filter(((F.col("c") + F.col("g")) / width >= gc) & (F.col("c") * F.col("g") > 0) & (F.col("cg") * width / (F.col("c") * F.col("g")) >= ratio))
    return merge_islands(kept.select(id_col, "start", (F.col("start") + width).alias("end")), [id_col])


def cpg_features(df: DataFrame, id_col: str, assembly: str, seq_col: str = "seq", **limits) -> DataFrame:
    """Islands as features of a chromosome: (feature_id, assembly_name, chr, start, end, track_type, mark_label, signal_value).

    Islands are numbered from 1 by their start; the signal is the observed / expected CpG of the whole island.
    """
    text = df.select(id_col, S.dna(F.col(seq_col)).alias("seq"))
    found = cpg_islands(text, id_col, "seq", **limits).join(text, id_col).withColumn("w", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    count = lambda p: F.regexp_count("w", F.lit(p))
    ratio = F.try_divide(count("CG") * F.length("w"), count("C") * count("G"))
    rows = found.select(F.col(id_col).cast("string").alias("chr"), "start", "end", F.coalesce(ratio, F.lit(0.0)).alias("signal_value"))
    number = F.row_number().over(Window.partitionBy("chr").orderBy("start"))
    rows = rows.withColumn("feature_id", F.concat(F.lit(f"CGI:{assembly}:"), "chr", F.lit(":"), number.cast("string")))
    return rows.select("feature_id", F.lit(assembly).alias("assembly_name"), "chr", "start", "end", F.lit("CpgIsland").alias("track_type"), F.format_string("CpG_Island_OE_%.2f", "signal_value").alias("mark_label"), "signal_value")

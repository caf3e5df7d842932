"""Language-model scores from a log-frequency Bloom filter.

Training n-grams (words, and pairs of words) are counted exactly, their counts quantised on a logarithmic scale, and an
n-gram of level j is entered into a Bloom filter with each of the levels 1 to j. A count is read back by repeated
membership probes: level 1, 2, ... until one fails. The filter is partitioned by n-gram hash into SEGMENTS that are built
where the counts are, and sent to the workers in groups of at most GROUP_BYTES, each a pass over the texts, never a larger
broadcast. A filter of over MOST_GROUPS groups is not broadcast: each batch of texts sends its distinct probes, dealt by
segment, to where the segments are, and their levels come back by batch. So the passes over the texts are bounded, and what
is shuffled is in proportion to the texts.

Probabilities are those of interpolated absolute discounting, from the counts q that the filter gives:

    p(w | v) = (max(q(v w) - d, 0) + d f(v) p(w)) / T(v),    p(w) = (q(w) + 1) / Z

f(v) is the number of different words after v, also kept in the filter; T(v) is the sum of q(v w) - d over all w seen
after v, plus d f(v); Z is the sum of q(w) + 1 over all words, plus 1 for all unknown words as one. So probabilities sum to
1 for every v, but for the filter's false positives. After a v never seen p(w | v) = p(w). T and Z are exact sums of what
the filter gives: they are made where the counts are. The end of a text counts as a word, and the first word has the end
before it; so the words before the tokens of a text are its tokens, and the T's part of the score is a sum over them.

Counting. A batch sends its distinct hashes, dealt by hash; words carry the documents they occur in, so the exact base sums
and those of T need no second look at the words. A pair goes where its first word goes. Words that make up a stated share of
a batch are counted apart (a short, bounded table), and pairs that begin with them are dealt by the pair, so no word gathers
more than that share in one task. Pairs are told apart by log2(N) + SPARE_BITS bits of their hash. Documents go by their
number in the batch (a byte or two in each bucket); the numbers' keys are sent once a batch, to where its sums meet.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import words
from strandframe.session import cut, drop_cut

#: Levels of the logarithmic scale: level j stands for counts from BASE^(j-1).
BASE = 2.0
#: Bits of the filter for an entry (an n-gram and a level), and probes of an entry.
BITS_AN_ENTRY = 10
PROBES = 4
#: Bytes of filter in one broadcast.
GROUP_BYTES = 96 << 20
#: So many groups are broadcast one after the other; with more the probes go to the segments.
MOST_GROUPS = 4
#: Bytes of probes that one task answers; a segment that is asked more goes to several.
ASKED_BYTES = 64 << 20
#: Entries that are put into a segment at once.
STEP = 1 << 18
#: What is taken from the count of each pair, for pairs not seen.
DISCOUNT = 0.75
#: Tokens of a batch, and the hashes of one counting task on average.
BATCH_TOKENS = 1 << 20
BATCH_ROWS = 60_000
BUCKET_HASHES = 1 << 21
#: A batch is sorted and sent in so many parts, by the first bits of the hash. There are as many buckets at least.
SEND_PARTS = 8
PART_SHIFT = np.uint64(64 - int(math.log2(SEND_PARTS)))
#: A word with a quarter of this share of all tokens, or with over APART of them, is counted apart: no bucket grows with the
#: input by it. A batch reports words with REPORTED of its tokens (twice at least).
COMMON = 0.002
APART = BUCKET_HASHES // 16
REPORTED = 16 / BATCH_TOKENS
#: Hashes of pairs are cut to so many bits more than the number of tokens needs.
SPARE_BITS = 13

END = np.uint64(0x7C0FFEE5EED5EED5)
#: What tells pairs and numbers of followers from words in the filter.
PAIR = np.uint64(0x1D8E4E27C47D124F)
FANS = np.uint64(0xEB44ACCAB455D165)
SENT = "key int, docs binary, hashes binary, repeats binary, owners binary, counts binary, contexts binary, fans binary, pairs binary, tallies binary"
COUNTED = "key int, part int, docs binary, logs binary, known binary, blob binary, entries long, distinct long"


def _keys(batch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def _batches(batches, keys_of=_keys):
    """(row keys, training flags, words, counts) of about BATCH_TOKENS tokens; the end of each text is its last word."""
    keys, flags, hashes, counts, total = [], [], [], [], 0
    for batch in batches:
        key, flag = keys_of(batch), batch.column(1).to_numpy(zero_copy_only=False)
        for first, block, count in words.word_batches(batch.column(2)):
            stop = np.cumsum(count)
            hashes.append(np.insert(block, stop, END))
            counts.append(count + 1)
            keys.append(key[first : first + len(count)])
            flags.append(flag[first : first + len(count)])
            total += len(hashes[-1])
            if total >= BATCH_TOKENS or sum(map(len, keys)) >= BATCH_ROWS - 5000:
                yield _joined(keys, flags, hashes, counts)
                total = 0
    if keys:
        yield _joined(keys, flags, hashes, counts)


def _joined(*lists) -> tuple:
    """Each list's arrays as one; the lists are emptied, so nothing holds the blocks beside the whole."""
    out = []
    for own in lists:
        out.append(np.concatenate(own))
        own.clear()
    return tuple(out)


def _pair(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hash of each word and the one before it."""
    return words.mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)


def _pairs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hash of each word and the one before it; the first has the end before it."""
    return _pair(np.concatenate(([END], hashes[:-1])), hashes)


def _count_common(batches):
    for keys, flags, hashes, counts in _batches(batches):
        train = np.repeat(flags, counts)
        value, n = np.unique(hashes[train], return_counts=True)
        yield_at = n >= min(COMMON / 2 * len(hashes), max(2, REPORTED * len(hashes)))
        value, n = value[yield_at], n[yield_at]
        rest = int(train.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(value.view(np.int64), np.int64(0))), pa.array(np.append(n, rest).astype(np.int64)), pa.array(np.append(np.ones(len(value), np.int32), np.int32(0)))], ["hash", "n", "kind"])


def _runs(values: np.ndarray):
    """(value, start, stop) of each run of equal values."""
    if len(values):
        bounds = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))).tolist()
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(values[i]), i, j


def _member(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def _send(buckets: int, bits: int, common):
    """Of a batch, for each bucket: postings of words, and how often each pair occurs in training; and, with a key from
    ``buckets`` on, the keys of its documents. docs: the batch's name, then numbers of documents (or all keys)."""

    def run(batches):
        shift, drop = np.uint64(64 - int(math.log2(buckets))), np.uint64(64 - bits)
        width = -(-bits // 8)
        apart = common.value
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array([r[k] for r in rows.values()], pa.binary()) for k in range(9))], [x.split()[0] for x in SENT.split(", ")])
        for keys, flags, hashes, counts in _batches(batches):
            owner = np.repeat(np.arange(len(keys), dtype=np.uint32), counts)
            train = np.repeat(flags, counts)
            name = xxhash.xxh3_64_digest(keys.tobytes() + flags.tobytes())
            yield table({buckets + int.from_bytes(name, "little") % buckets: [name + keys.astype("<i8").tobytes(), *[b""] * 8]})
            # Buckets go by the first bits: an eighth of them at a time, as sorting takes several times what it sorts.
            before = np.concatenate(([END], hashes))
            hashes, before = before[1:], before[:-1]
            pair, known, part, pair_part = np.empty_like(hashes), np.empty(len(hashes) + 1, bool), np.empty(len(hashes), np.uint8), np.empty(len(hashes), np.uint8)
            known[0] = _member(apart, before[:1])[0][0]
            known, after_known = known[1:], known[:-1]
            for i in range(0, len(hashes), STEP):
                step = slice(i, i + STEP)
                pair[step] = _pair(before[step], hashes[step])
                known[step] = _member(apart, hashes[step])[0]
                part[step] = hashes[step] >> PART_SHIFT
                pair_part[step] = np.where(after_known[step], pair[step], before[step]) >> PART_SHIFT
            for k in range(SEND_PARTS):
                rows: dict[int, list] = {}
                # pairs, each once, by (bucket, first word)
                at = np.flatnonzero(train & (pair_part == k))
                each, first, tally = np.unique(pair[at], return_index=True, return_counts=True)
                at = at[first]
                context = before[at]
                bucket = (np.where(after_known[at], each, context) >> shift).astype(np.int64)
                order = np.lexsort((context, bucket))
                bucket, context, each, tally = bucket[order], context[order], each[order] >> drop, tally[order]
                for b, i, j in _runs(bucket):
                    contexts, fans = np.unique(context[i:j], return_counts=True)
                    short = np.ascontiguousarray(each[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
                    rows[b] = [b"", b"", b"", b"", b"", words.pack(contexts), _narrowed(fans), short.tobytes(), _narrowed(tally[i:j])]
                mine = part == k
                value, n = np.unique(hashes[mine & known & train], return_counts=True)
                at = np.flatnonzero(mine & ~known)
                # one entry for each word and document: how often; training documents first
                own, code = hashes[at], (owner[at] << np.uint32(1)) | train[at]
                order = np.lexsort((code, own))
                own, code = own[order], code[order]
                start = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (code[1:] != code[:-1])))) if len(own) else np.zeros(0, np.int64)
                times = np.diff(np.append(start, len(own)))
                own, code = own[start], code[start]
                held = {b: (i, j) for b, i, j in _runs((own >> shift).astype(np.int64))}
                alone = {b: (i, j) for b, i, j in _runs((value >> shift).astype(np.int64))}
                for b in held.keys() | alone.keys():
                    (i, j), (p, q) = held.get(b, (0, 0)), alone.get(b, (0, 0))
                    used, local = np.unique((code[i:j] >> np.uint32(1)).astype(np.int64), return_inverse=True)
                    train_bit = code[i:j] & np.uint32(1)
                    # counts of words counted apart are documents' zeroth: owner 0xFFFFFFFF
                    owners = np.concatenate(((local.astype(np.uint32) << np.uint32(1)) | train_bit, np.full(q - p, 0xFFFFFFFF, np.uint32)))
                    whole = np.concatenate((own[i:j], value[p:q]))
                    often = np.concatenate((times[i:j], n[p:q])).astype(np.uint32)
                    order = np.argsort(whole, kind="stable")
                    narrow = np.uint16 if owners.size == 0 or (len(used) < 32000 and q == p) else np.uint32
                    each, repeats = np.unique(whole, return_counts=True)
                    rows.setdefault(b, [b""] * 9)[:5] = [name + words.pack(used.astype(np.uint64)), words.pack(each), _narrowed(repeats), bytes([np.dtype(narrow).itemsize]) + owners[order].astype(narrow).tobytes(), _narrowed(often[order])]
                if rows:
                    yield table(rows)

    return run


def _narrowed(values: np.ndarray) -> bytes:
    """Counts as the fewest bytes each; ``_unpacked`` restores them."""
    most = int(values.max(initial=0))
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint8)
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]], offset=1)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more at each power of BASE."""
    return 1 + np.floor(np.log2(np.maximum(counts, 1)) / math.log2(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for (0 for none): the middle of its range."""
    low = BASE ** (np.maximum(level, 1) - 1)
    return np.where(level > 0, (low + np.maximum(low, BASE * low - 1)) / 2, 0.0)


def _places(hashes: np.ndarray, level: int | np.ndarray, size: int):
    """Bit places of entries (hash, level) in a segment of ``size`` bits, one array for each probe."""
    first = words.mix(hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level).astype(np.uint64))
    step = words.mix(first) | np.uint64(1)
    for k in range(PROBES):
        yield ((first + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


def segment_bits(entries: int, bits_an_entry: int = BITS_AN_ENTRY) -> int:
    return max(64, -(-bits_an_entry * entries // 64) * 64)


def build_segment(hashes: np.ndarray, counts: np.ndarray, bits_an_entry: int = BITS_AN_ENTRY) -> bytes:
    steps = [slice(i, i + STEP) for i in range(0, len(hashes), STEP)]
    level = np.concatenate([np.zeros(0, np.uint8), *(levels(counts[step]).astype(np.uint8) for step in steps)])
    size = segment_bits(int(level.sum(dtype=np.int64)), bits_an_entry)
    bits = np.zeros(size, np.uint8)
    for step in steps:
        for j in range(1, int(level[step].max()) + 1):
            own = hashes[step][level[step] >= j]
            for place in _places(own, j, size):
                bits[place] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """A group of segments; probing an n-gram whose segment is elsewhere gives level 0."""

    def __init__(self, segments: dict[int, bytes], buckets: int):
        self.buckets = buckets
        self.keys = sorted(segments)
        sizes = [len(segments[k]) for k in self.keys]
        self.start = np.zeros(buckets, np.int64)
        self.size = np.zeros(buckets, np.uint64)
        for k, at, size in zip(self.keys, np.concatenate(([0], np.cumsum(sizes[:-1]))).tolist() if sizes else [], sizes, strict=True):
            self.start[k], self.size[k] = 8 * at, 8 * size
        self.bytes = np.frombuffer(b"".join(segments[k] for k in self.keys), np.uint8)

    def level(self, bucket: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint8)
        left = np.flatnonzero(self.size[bucket] > 0)
        start, size, own = self.start[bucket[left]], self.size[bucket[left]], hashes[left]
        j = 0
        while len(left) and j < 60:
            j += 1
            hit = np.ones(len(left), bool)
            first = words.mix(own + np.uint64(0x9E3779B97F4A7C15 * j & (1 << 64) - 1))
            step = words.mix(first) | np.uint64(1)
            for k in range(PROBES):
                place = start + ((first + np.uint64(k) * step) % size).astype(np.int64)
                hit &= (self.bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
            left, start, size, own = left[hit], start[hit], size[hit], own[hit]
            out[left] = j
        return out


def quantised(counts: np.ndarray) -> np.ndarray:
    """What the filter gives for counts from 1 on."""
    return level_count(levels(counts))


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value once, in order; the order of all values, equal ones as they came; where each value's run starts in it."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[start], order, start


def _added(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs that start there."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    return np.add.reduceat(values, start, dtype=kind) if len(start) else np.zeros(0, kind)


def _count(parts: int, bits: int, common, bits_an_entry: int):
    """Exact counts of one bucket: its filter segment, sums for Z, each document's sums of log10(c + 1) and of log10 T, and
    parts of T for words counted apart."""

    def run(key, table):
        key, width = key[0].as_py(), -(-bits // 8)
        column = lambda name: (memoryview(x.as_buffer()) for x in table.column(name))  # noqa: E731  no copy
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        rows = lambda out: pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in COUNTED.split(", ")])
        if key >= parts:
            return rows([(key, key - parts, x, b"", b"", b"", 0, 0) for x in dict.fromkeys(map(bytes, column("docs")))])
        # pairs: of each first word the sum of q - d, and how many words follow it
        size = sum(map(len, column("pairs"))) // width
        context, pair, tally, i = np.empty(size, np.uint64), np.zeros((size, 8), np.uint8), np.empty(size, np.uint32), 0
        for words_of, fan, short, tallies in zip(*map(column, ("contexts", "fans", "pairs", "tallies")), strict=True):
            j = i + len(short) // width
            context[i:j] = np.repeat(words.unpack(words_of), _unpacked(fan))
            pair[i:j, :width] = np.frombuffer(short, np.uint8).reshape(-1, width)
            tally[i:j] = _unpacked(tallies)
            i = j
        pair, order, start = _grouped(pair.reshape(-1).view("<u8"))
        pair_count = _added(tally[order], start)
        before, order, start = _grouped(context[order[start]])
        del context, tally
        mass, fans = _added(quantised(pair_count)[order] - DISCOUNT, start), np.diff(np.append(start, len(order)))
        held = _member(common.value, before)[0]
        out: list[tuple] = []
        if held.any():
            out.append((key, -3, before[held].tobytes(), mass[held].tobytes(), fans[held].tobytes(), b"", 0, 0))
        before, mass, fans = before[~held], mass[~held], fans[~held]
        log_t = np.log10(mass + DISCOUNT * quantised(fans))
        # words
        docs, starts = [bytes(x) for x in column("docs")], [0]
        sizes = [int(_unpacked(x).sum(dtype=np.int64)) for x in column("repeats")]
        value, owner, count, i = np.empty(sum(sizes), np.uint64), np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.uint32), 0
        for doc, n, each, repeats, own, often in zip(docs, sizes, *map(column, ("hashes", "repeats", "owners", "counts")), strict=True):
            value[i : i + n] = np.repeat(words.unpack(each), _unpacked(repeats))
            own = _unpacked(own).astype(np.int64)
            owner[i : i + n] = np.where(own == 0xFFFFFFFF, -1, own + 2 * starts[-1])
            count[i : i + n] = _unpacked(often)
            starts.append(starts[-1] + len(words.unpack(doc[8:])))
            i += n
        distinct, order, start = _grouped(value)
        del value
        owner, count = owner[order], count[order]
        at = np.repeat(np.arange(len(distinct), dtype=np.int32), np.diff(np.append(start, len(order))))
        del order
        c = _added(np.where((owner < 0) | (owner & 1 == 1), count, 0), start)
        seen = c > 0
        blob = build_segment(np.concatenate((distinct[seen], words.mix(pair + PAIR), words.mix(before + FANS))), np.concatenate((c[seen], pair_count, fans)), bits_an_entry)
        del pair, pair_count
        out.append((key, -1, b"", b"", b"", blob, int(2 * quantised(c[seen]).sum()), int(seen.sum())))  # q is a multiple of a half
        apart = np.unique(at[owner < 0])
        if len(apart):  # their counts go to the scoring pass
            out.append((key, -2, distinct[apart].tobytes(), c[apart].tobytes(), b"", b"", 0, 0))
        found, place = _member(before, distinct)
        logs_t = np.where(found, log_t[place], 0.0) if len(before) else np.zeros(len(distinct))
        own = owner >= 0
        row, at, count = owner[own] >> 1, at[own], count[own]
        del owner, own
        logs, known, logs_t = (np.bincount(row, weights=each[at] * count, minlength=starts[-1]) for each in (np.log10(c + 1.0), seen, logs_t))
        for doc, i, j in zip(docs, starts[:-1], starts[1:], strict=True):
            if i < j:
                out.append((key, int.from_bytes(doc[:8], "little") % parts, doc, logs[i:j].tobytes(), _narrowed(known[i:j].astype(np.int64)), logs_t[i:j].tobytes(), 0, 0))
        return rows(out)

    return run


def _sums(parts: int):
    """Of each batch of a group its documents' keys and sums."""

    def run(key, table):
        keys, sums = {}, {}
        for of, doc in zip(table.column("key").to_pylist(), table.column("docs").to_pylist(), strict=True):
            if of >= parts:
                keys[doc[:8]] = np.frombuffer(doc, "<i8", offset=8)
                sums[doc[:8]] = np.zeros((3, len(keys[doc[:8]])))
        for of, doc, *blobs in zip(*(table.column(c).to_pylist() for c in ("key", "docs", "logs", "known", "blob")), strict=True):
            if of < parts:
                at = words.unpack(doc[8:]).astype(np.int64)
                for total, own in zip(sums[doc[:8]], (np.frombuffer(blobs[0]), _unpacked(blobs[1]), np.frombuffer(blobs[2])), strict=True):
                    total[at] += own
        row = np.concatenate([np.zeros(0, np.int64), *keys.values()])
        logs, known, logs_t = np.concatenate([np.zeros((3, 0)), *sums.values()], axis=1)
        return pa.table({"row": row, "logs": logs, "known": known.astype(np.int64), "logs_t": logs_t})

    return run


def _parts_of_t(batches):
    for batch in batches:
        hashes, mass, fans = (np.concatenate([np.zeros(0, t), *(np.frombuffer(b, t) for b in batch.column(k).to_pylist())]) for k, t in enumerate((np.int64, np.float64, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(mass), pa.array(fans)], ["hash", "mass", "fans"])


class _Settings:
    """What a scoring pass needs beside the filter: of words counted apart (hashes, sorted) their counts, quantised numbers of
    followers and log10 T; sums over all words."""

    def __init__(self, buckets: int, bits: int, hashes: np.ndarray, counts: np.ndarray, fans: np.ndarray, log_t: np.ndarray, z: float):
        self.buckets, self.bits, self.hashes, self.counts, self.fans, self.log_t, self.z = buckets, bits, hashes, counts, fans, log_t, z


def _probes(s: _Settings, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is to be asked of the filter, each once: segments and n-grams, in order of both; and for each word the places of
    the word, of its pair with the word before it and of its number of followers."""
    shift, drop = np.uint64(64 - int(math.log2(s.buckets))), np.uint64(64 - s.bits)
    each, at = np.unique(hashes, return_inverse=True)
    before = np.concatenate(([END], hashes[:-1]))
    pair, first, of = np.unique(_pairs(hashes, counts), return_index=True, return_inverse=True)
    before = before[first]
    dealt = np.where(_member(s.hashes, before)[0], pair, before)
    bucket = (np.concatenate((each, each, dealt)) >> shift).astype(np.int64)
    value = np.concatenate((each, words.mix(each + FANS), words.mix((pair >> drop) + PAIR)))
    order = np.lexsort((value, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return bucket[order], value[order], np.stack((place[at], place[2 * len(each) + of], place[len(each) + at]))


def _levels_of(model: Filter, s: _Settings, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Levels of each word, of its pair with the word before it, and of its number of followers, as far as this filter tells."""
    shift, drop = np.uint64(64 - int(math.log2(s.buckets))), np.uint64(64 - s.bits)
    each, at = np.unique(hashes, return_inverse=True)
    bucket = (each >> shift).astype(np.int64)
    one, fans = model.level(bucket, each)[at], model.level(bucket, words.mix(each + FANS))[at]
    pair, before = _pairs(hashes, counts), np.concatenate(([END], hashes[:-1]))
    bucket = (np.where(_member(s.hashes, before)[0], pair, before) >> shift).astype(np.int64)
    return np.stack((one, model.level(bucket, words.mix((pair >> drop) + PAIR)), fans))


def _log_terms(s: _Settings, found: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of p(w | v) T(v) of each word."""
    one, two, fans = (level_count(x.astype(np.int64)) for x in found)
    common, at = _member(s.hashes, hashes)
    if len(s.hashes):
        fans = np.where(common, s.fans[at], fans)
    ends = np.cumsum(counts)
    before = np.concatenate(([0.0], fans[:-1]))
    before[ends - counts] = fans[ends - 1]  # the end, which is each text's last word
    p = (one + 1) / s.z
    return np.log10(np.where(before > 0, np.where(two > 0, two - DISCOUNT, 0.0) + DISCOUNT * before * p, p))


def _sums_of_texts(s: _Settings, found: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple:
    """Of each text its number of tokens, the sums over words counted apart, and its score without the part of T."""
    starts = np.cumsum(counts) - counts
    common, at = _member(s.hashes, hashes)
    of_common = lambda x: np.add.reduceat(np.where(common, x[at], 0) if len(x) else np.zeros(len(common), x.dtype), starts)
    score = np.add.reduceat(_log_terms(s, found, hashes, counts), starts) - of_common(s.log_t)
    return counts, of_common(np.log10(s.counts + 1.0)), of_common((s.counts > 0).astype(np.int64)), score


def _score(model, settings, carried: bool, last: bool):
    """A pass over the texts with one group of the filter. Levels found so far are carried along as bytes."""

    def run(batches):
        m, s = model.value, settings.value
        for batch in batches:
            found_before = batch.column(4).to_pylist() if carried else None
            blobs, out = [], []
            for first, block, count in words.word_batches(batch.column(3)):
                stop = np.cumsum(count)
                hashes, counts = np.insert(block, stop, END), count + 1
                found = _levels_of(m, s, hashes, counts)
                ends = np.cumsum(counts)
                starts = ends - counts
                if found_before:
                    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                        found[:, a:b] = np.maximum(found[:, a:b], np.frombuffer(found_before[first + i], np.uint8).reshape(3, -1))
                if not last:
                    blobs += [found[:, a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                    continue
                out.append(_sums_of_texts(s, found, hashes, counts))
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blobs, pa.binary())], ["row", "doc_id", "train", "text", "found"])
            elif out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(np.concatenate(x)) for x in zip(*out, strict=True))], ["row", "doc_id", "train", "n_tokens", "c_logs", "c_known", "score"])

    return run


HELD = "batch long, bucket int, probes binary, rows binary, hashes binary, counts binary"
SCORED = "row long, doc_id long, train boolean, n_tokens long, c_logs double, c_known long, score double"


def _hold(settings):
    """A row for each batch of texts: a name that no other has, (row, id, null id, training) of its rows, its words; and one
    for each segment that it asks. Both in one pass, so no worker reads the words of several batches again."""
    own = lambda b: np.stack((_keys(b), b.column(3).fill_null(0).to_numpy(zero_copy_only=False), b.column(3).is_null().to_numpy(zero_copy_only=False)), axis=1).astype("<i8")
    binary = lambda values: pa.array(values, pa.binary())

    def run(batches):
        for keys, flags, hashes, counts in _batches(batches, own):
            name = int.from_bytes(os.urandom(8), "little", signed=True)
            rows = np.concatenate((keys, flags.astype("<i8")[:, None]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *(binary([x.tobytes()]) for x in (rows, hashes.astype("<u8"), counts.astype("<i8")))], [x.split()[0] for x in HELD.split(", ")])
            bucket, value, _ = _probes(settings.value, hashes, counts)
            asked = [(b, words.pack(value[i:j])) for b, i, j in _runs(bucket)]
            del bucket, value
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(asked), pa.int64()), pa.array([b for b, _ in asked], pa.int32()), binary([x for _, x in asked]), *(pa.nulls(len(asked), pa.binary()) for _ in range(3))], [x.split()[0] for x in HELD.split(", ")])

    return run


def _answer(asked, segments):
    """Levels of one segment's probes, in their order; zeros, if it is not there."""
    own = Filter(dict(enumerate(segments.column("blob").to_pylist()[:1])), 1)
    names, keys, probes = (asked.column(c).to_pylist() for c in ("batch", "bucket", "probes"))
    values = map(words.unpack, probes)
    levels = [own.level(np.zeros(len(value), np.int64), value).tobytes() for value in values]
    return pa.table([pa.array(names, pa.int64()), pa.array(keys, pa.int32()), pa.array(levels, pa.binary())], names=["batch", "bucket", "levels"])


def _score_held(settings):
    def run(held, answers):
        s, out = settings.value, []
        levels = dict(zip(answers.column("bucket").to_pylist(), answers.column("levels").to_pylist(), strict=True))
        for rows, hashes, counts in zip(*(held.column(c).to_pylist() for c in ("rows", "hashes", "counts")), strict=True):
            rows = np.frombuffer(rows, "<i8").reshape(-1, 4)
            hashes, counts = np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<i8")
            found = np.frombuffer(b"".join(levels[b] for b in sorted(levels)), np.uint8)[_probes(s, hashes, counts)[2]]
            ids = pa.array(rows[:, 1], mask=rows[:, 2] > 0)
            out.append(pa.table([pa.array(rows[:, 0]), ids, pa.array(rows[:, 3] > 0), *map(pa.array, _sums_of_texts(s, found, hashes, counts))], names=[x.split()[0] for x in SCORED.split(", ")]))
        return pa.concat_tables(out)

    return run


def _score_by_segments(keyed: DataFrame, segments: DataFrame, settings) -> DataFrame:
    """The scores of all texts without a broadcast of the filter. segments: (key, blob)."""
    both = cut(keyed.select("row", "train", "text", "doc_id").mapInArrow(words.freeing(_hold(settings)), HELD))
    held = both.filter("bucket is null").select("batch", "rows", "hashes", "counts")
    asked = both.filter("bucket is not null").select("batch", "bucket", "probes")
    # A word of all batches is asked by each: what one segment is asked goes to as many tasks as it takes.
    tasks = asked.groupBy("bucket").agg(F.ceil(F.sum(F.length("probes")) / F.lit(ASKED_BYTES)).cast("int").alias("tasks"))
    dealt = asked.join(tasks, "bucket").withColumn("task", F.pmod("batch", F.col("tasks")).cast("int"))
    own = segments.select(F.col("key").alias("bucket"), "blob").join(tasks, "bucket").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    met = dealt.select("bucket", "task", "batch", "probes").groupBy("bucket", "task").cogroup(own.select("bucket", "task", "blob").groupBy("bucket", "task"))
    levels = met.applyInArrow(words.freeing_cogroups(_answer), "batch long, bucket int, levels binary")
    out = cut(held.groupBy("batch").cogroup(levels.groupBy("batch")).applyInArrow(words.freeing_cogroups(_score_held(settings)), SCORED))
    drop_cut(both)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, bits_an_entry: int = BITS_AN_ENTRY, most_groups: int = MOST_GROUPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Null and empty texts have one token, the end. A null id is not held out: it is learnt from. Repeated rows are learnt
    from and returned each. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~held).alias("train"), text.alias("text"))
    # The key of a row is its id and text; rows that are wholly equal share their sums evenly.
    keyed = keyed.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "doc_id", "train", "text")
    source = keyed.select("row", "train", "text")
    seen = cut(source.mapInArrow(words.freeing(_count_common), "hash long, n long, kind int"))
    total = seen.filter("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # There are 4 / COMMON at most, or one for each APART tokens.
    common = [r[0] for r in seen.filter("kind = 1").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(min(COMMON / 4 * total, float(APART)))).collect()]
    common = np.sort(np.array(common, np.int64).view(np.uint64))
    buckets = max(SEND_PARTS, 1 << math.ceil(math.log2(max(1, total / BUCKET_HASHES))))
    bits = min(64, max(32, int(total).bit_length() + SPARE_BITS))
    parts = buckets
    drop_cut(seen)
    apart = spark.sparkContext.broadcast(common)
    sent = source.mapInArrow(words.freeing(_send(buckets, bits, apart)), SENT)
    counted = cut(sent.groupBy("key").applyInArrow(words.freeing_groups(_count(parts, bits, apart, bits_an_entry)), COUNTED))
    # A group is one batch, by its name: parts of several would differ in size.
    sums = counted.filter("part >= 0").groupBy(F.substring("docs", 1, 8)).applyInArrow(words.freeing_groups(_sums(parts)), "row long, logs double, known long, logs_t double")
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("logs", "known", "logs_t")))
    rows = counted.filter("part = -2").select("docs", "logs").collect()  # a row a bucket that has a common word
    counts = dict(zip(*(np.concatenate([np.frombuffer(r[k], t) for r in rows] or [np.zeros(0, t)]).tolist() for k, t in enumerate((np.uint64, np.int64))), strict=True))
    of_t = counted.filter("part = -3").select("docs", "logs", "known").mapInArrow(_parts_of_t, "hash long, mass double, fans long")
    of_t = {int(np.int64(r.hash).view(np.uint64)): (r.mass, r.fans) for r in of_t.groupBy("hash").agg(F.sum("mass").alias("mass"), F.sum("fans").alias("fans")).collect()}  # a row a common word
    fans = np.array([of_t.get(h, (0.0, 0))[1] for h in common.tolist()], np.int64)
    degree = np.where(fans > 0, quantised(fans), 0.0)
    mass = np.array([of_t.get(h, (0.0, 0))[0] for h in common.tolist()]) + DISCOUNT * degree
    segments = counted.filter("part = -1")
    held_bytes, entries, distinct = segments.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.length("blob"), F.col("entries"), F.col("distinct")))).first()
    z = entries / 2 + distinct + 1
    settings = _Settings(buckets, bits, common, np.array([counts.get(h, 0) for h in common.tolist()], np.int64), degree, np.log10(np.where(mass > 0, mass, 1.0)), z)
    shared = spark.sparkContext.broadcast(settings)

    passed, groups = keyed, [[]]
    if held_bytes > most_groups * group_bytes:
        passed, groups = _score_by_segments(keyed, segments.select("key", "blob"), shared), []
    else:
        size = 0
        for r in segments.select("key", F.length("blob").alias("size")).orderBy("key").collect():  # bounded as the bytes are
            if groups[-1] and size + r.size > group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(r.key)
            size += r.size
    for k, group in enumerate(groups):
        blobs = {r.key: bytes(r.blob) for r in segments.filter(F.col("key").isin(group)).select("key", "blob").toLocalIterator()}
        model = spark.sparkContext.broadcast(Filter(blobs, buckets))
        del blobs
        last = k == len(groups) - 1
        schema = SCORED if last else "row long, doc_id long, train boolean, text string, found binary"
        step = passed.mapInArrow(words.freeing(_score(model, shared, k > 0, last)), schema)
        if not last:
            step = cut(step)
            drop_cut(passed)
        passed = step
    copies = keyed.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1")
    sums = sums.join(copies, "row", "left").select("row", *((F.col(c) / F.coalesce("copies", F.lit(1))).alias(c) for c in ("logs", "known", "logs_t")))
    scored = passed.join(sums, "row", "left")
    base = F.coalesce("logs", F.lit(0.0)) + F.col("c_logs") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.coalesce("known", F.lit(0.0)).cast("long") + F.col("c_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") - F.coalesce("logs_t", F.lit(0.0))).alias("score"))

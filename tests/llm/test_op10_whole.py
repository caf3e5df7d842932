"""The score is the log-probability of a normalised model, whose brute-force twin is here."""

import collections
import math
import random
import tracemalloc
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandframe.llm import lm

HELD = lambda i: zlib.crc32(str(i).encode()) % 7 == 2


def q(n):
    return float(lm.quantised(np.array([n]))[0]) if n else 0.0


class Twin:
    def __init__(self, texts):
        self.one, self.two = collections.Counter(), collections.Counter()
        for text in texts:
            own = [*text.split(), None]
            self.one.update(own)
            self.two.update(zip([None, *own[:-1]], own, strict=True))
        self.after = collections.defaultdict(list)
        for (v, _), n in self.two.items():
            self.after[v].append(q(n) - lm.DISCOUNT)
        self.z = sum(q(n) + 1 for n in self.one.values()) + 1

    def p(self, w, v):
        alone = (q(self.one[w]) + 1) / self.z
        if v not in self.after:
            return alone
        fans = q(len(self.after[v]))
        return (max(q(self.two[v, w]) - lm.DISCOUNT, 0) + lm.DISCOUNT * fans * alone) / (sum(self.after[v]) + lm.DISCOUNT * fans)

    def score(self, text):
        own = [*text.split(), None]
        return sum(math.log10(self.p(w, v)) for v, w in zip([None, *own[:-1]], own, strict=True))


def corpus(n, words, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(words)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    held = next(i for i in range(1000, 2000) if HELD(i))
    return [*rows, (held, "never seen w1 words w2 w1 at all"), (held, "never seen w1 words w2 w1 at all"), rows[5]]


@pytest.mark.parametrize(("n", "options"), [(30, {}), (400, {}), (400, {"group_bytes": 20_000, "most_groups": 1000}), (400, {"group_bytes": 20_000}), (30, {"most_groups": 0})])
def test_score_is_its_twin(spark, n, options):
    rows = corpus(n, 500)
    twin = Twin([t for i, t in rows if not HELD(i)])
    got = lm.score(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double"), bits_an_entry=64, **options).collect()
    assert len(got) == len(rows)
    want = collections.defaultdict(set)
    for i, t in rows:
        want[i].add(t)
    wrong = [r for r in got if r.score != pytest.approx(twin.score(next(iter(want[r.doc_id]))), rel=1e-9)]
    assert len(wrong) <= len(rows) / 100  # a false positive of the filter


def test_probabilities_sum_to_one():
    twin = Twin([t for _, t in corpus(200, 300)])
    for v in [*list(twin.one)[:40], "never seen"]:
        assert sum(twin.p(w, v) for w in [*twin.one, "an unknown word"]) == pytest.approx(1, rel=1e-9)


def test_texts_seen_twice_stand_apart(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    learnt = [i for i in range(3000) if not HELD(i)]
    rows = [(i, text()) for i in learnt[:600]]
    rows += [(learnt[700 + k], rows[k][1]) for k in range(30)]
    twice = {r[0] for r in rows[:30]} | {r[0] for r in rows[600:]}
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = sorted(v for k, v in got.items() if k not in twice)
    assert min(got[k] for k in twice) > once[int(0.98 * len(once))]


def test_probes_that_go_to_the_segments_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "ASKED_BYTES", 2000)
    texts = [*corpus(300, 300), (None, "w1 w2 never seen"), (None, None), (7, None), (7, ""), (8, "w1 " * 3000), (8, "w1 " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, batch string")
    rows = lambda n: sorted((tuple(r) for r in lm.score(docs, most_groups=n).collect()), key=repr)
    assert rows(0) == rows(1)
    assert len(rows(0)) == len(texts)
    assert lm.score(docs.limit(0), most_groups=0).count() == 0


def test_words_counted_apart_do_not_depend_on_the_share():
    batch = np.arange(1 << 20, dtype=np.uint64) + np.uint64(1 << 40)
    batch[:100] = 7  # a ten-thousandth: of 10^9 tokens 10^5
    common = lm._count_common(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([True]), pa.array([" ".join(f"{x:x}" for x in batch.tolist())])], ["row", "train", "text"])]))
    assert [100] == [n for r in common for n, kind in zip(r.column(1).to_pylist(), r.column(2).to_pylist(), strict=True) if kind]


def test_many_words_counted_apart_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(200, 300), "doc_id long, text string")
    rows = lambda: sorted(map(tuple, lm.score(docs, bits_an_entry=64).collect()))
    want = rows()
    monkeypatch.setattr(lm, "APART", 3)
    for a, b in zip(rows(), want, strict=True):
        assert a == pytest.approx(b, rel=1e-9)


def test_a_batch_is_sent_in_little_memory():
    rng = np.random.Generator(np.random.PCG64(5))
    tokens = rng.zipf(1.2, (2000, 525)) % 10**7
    texts = [" ".join(map(str, row)) for row in tokens.tolist()]  # one batch, of just over BATCH_TOKENS
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([i % 7 != 2 for i in range(2000)]), pa.array(texts)], ["row", "train", "text"])
    common = types.SimpleNamespace(value=np.zeros(0, np.uint64))
    list(lm._send(16, 40, common)(iter([batch.slice(0, 10)])))  # tables of powers are made once
    tracemalloc.start()
    try:
        size = sum(x.nbytes for x in lm._send(16, 40, common)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 5e6
    assert most < 75 * lm.BATCH_TOKENS


@pytest.mark.parametrize("buckets", [8, 64])
def test_parts_of_a_batch_hold_every_word_and_pair(buckets):
    rows = [(i, t) for i, t in corpus(300, 400) if t]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([not HELD(i) for i, _ in rows]), pa.array([t for _, t in rows])], ["row", "train", "text"])
    hashes = np.concatenate([np.append(h, lm.END) for _, t in rows for _, h, _ in lm.words.word_batches(pa.array([t]))])
    common = types.SimpleNamespace(value=np.unique(hashes)[::5])
    sent = [r for b in lm._send(buckets, 64, common)(iter([batch])) for r in b.to_pylist()]
    assert len({r["key"] for r in sent}) == len(sent)  # a bucket has one row of a batch
    twin = Twin([t for i, t in rows if not HELD(i)])
    pairs = np.concatenate([lm._unpacked(r["tallies"]) for r in sent])
    assert sorted(pairs.tolist()) == sorted(twin.two.values())
    held = np.concatenate([lm.words.unpack(r["hashes"]) for r in sent])
    told = [x for x in np.unique(hashes).tolist() if x not in set(common.value.tolist())]
    assert set(told) <= set(held.tolist())
    assert len(held) == len(set(held.tolist()))
    assert all(int(h) >> 64 - int(math.log2(buckets)) == r["key"] for r in sent if r["hashes"] for h in lm.words.unpack(r["hashes"]))

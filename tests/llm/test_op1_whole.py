"""What a batch of postings sends does not grow with the number of parts; hot tokens, large buckets, components."""

import collections
import random

import numpy as np
import pyarrow as pa

from strandframe.llm import components, ngram_jaccard, words
from test_llm_operators import components_of


class _Held:
    def __init__(self, value):
        self.value = value


def _batch(sets, common_words, seed):
    rng = random.Random(seed)
    shared = " ".join(f"common{k}" for k in range(common_words))
    texts = [f"{shared} " + " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(20)) for _ in range(sets)]
    return pa.RecordBatch.from_arrays([pa.array(range(sets), pa.int64()), pa.array(texts), pa.nulls(sets, pa.int64())], ["doc_id", "text", "key"])


def test_bytes_of_a_batch_stay_flat():
    batch = _batch(3000, 34, 1)
    shared = [s for _, s in words.shingle_sets(batch.column(1))]
    token, count = np.unique(np.concatenate(shared) >> ngram_jaccard.TOKEN_BITS, return_counts=True)
    common = token[count == 3000]
    assert len(common) == 30
    sent = {}
    for parts in (16, 256, 4096):
        out = list(ngram_jaccard._postings(5, parts, parts, _Held(common))(iter([batch])))
        sent[parts] = sum(len(x) for b in out for c in range(1, 5) for x in b.column(c).to_pylist())
        assert sum(len(b) for b in out) <= 2 * parts
    # each node is sent once with its common tokens, and with each bucket that holds some of its others
    assert sent[4096] < 3 * sent[16] and sent[4096] < 2_500_000


def test_batches_of_few_long_sets_report_common_tokens():
    batch = _batch(12, 34, 2)
    out = [b for b in ngram_jaccard._rows(5)(iter([batch]))]
    found = [x for b in out for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if k == 1]
    assert len(found) == 30 and set(found) == {12}


def test_hot_passage_and_large_groups(spark, monkeypatch):
    """Every bucket in pieces of three nodes, several tokens in the table of common ones."""
    monkeypatch.setattr(ngram_jaccard, "PIECE", 3)
    monkeypatch.setattr(ngram_jaccard, "COMMON_LEAST", 8)
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(1 << 30)}" for _ in range(n)]
    passage, rows = say(40), []
    for k in range(120):  # all hold the passage; some few are alike beyond it
        own = say(rng.choice((6, 9, 30)))
        for _ in range(rng.choice((1, 1, 3))):
            text = list(passage) + own
            text[rng.randrange(40, len(text))] = "changed"
            rows.append((len(rows), " ".join(text)))
    base = say(80)
    for _ in range(90):  # a chain of near copies
        base[rng.randrange(80)] = say(1)[0]
        rows.append((len(rows), " ".join(base)))
    rows += [(5, rows[5][1]), (None, None), (None, rows[7][1])]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, m int, sig int, salt int")).collect()
    assert collections.Counter(map(tuple, got)) == components_of(rows)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(400 + k, 401 + k) for k in range(60)]
    links += [links[0], (7, 7), (None, 3), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

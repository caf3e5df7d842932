"""Every stage of the pipeline on a small corpus: what it keeps and changes, against brute force."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import ngram_jaccard, quality, secrets
from test_bpe import library
from test_llm_operators import components_of, shingles

KEY = "q8Zr2LxV7nTfK4wPbYs9"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    good = lambda n=40: [rng.choice(vocabulary) for _ in range(n)]
    junk = lambda: " ".join("!!" + "".join(rng.choice("XYZ$#") for _ in range(6)) for _ in range(40))
    items = [(k, " ".join(good(20))) for k in range(4)] + [(9, None), (10, "")]
    rows = [(i, " ".join(good()) if i % 5 else junk()) for i in range(150)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 150, 2)]
    base = good(60)
    for k in range(6):  # near copies
        own = list(base)
        own[k] = "other"
        rows.append((200 + k, " ".join(own)))
    rows += [(300, rows[7][1]), (7, rows[7][1]), (8, rows[9][1]), (None, rows[11][1]), (None, " ".join(good())), (None, None), (301, None), (302, ""), (303, "")]
    rows += [(400, " ".join(good(10)) + " " + items[1][1] + " " + " ".join(good(30))), (401, items[2][1])]
    rows += [(500, " ".join(good(30)) + f" the authorization {KEY} " + " ".join(good(5))), (501, " ".join(good(30)) + " password = hunter2hunter")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t) if t is not None else None, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, key int")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return folder, items


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, corpus, word_bpe):
    folder, items = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"file://{folder}/documents.parquet")
    labels = spark.read.parquet(f"file://{folder}/labels.parquet")

    good = corpus_pipeline.cut(stages["quality classifier"](spark, docs, f"file://{folder}"))
    assert good.columns == docs.columns
    scores = quality.score(docs.withColumn("doc_id", F.monotonically_increasing_id()), labels.limit(0)).count()
    assert scores == docs.count()
    kept = rows_of(good)
    assert not [i for i, t in kept if i is not None and i < 150 and i % 5 == 0] and len({i for i, t in kept if i is not None and i < 150 and i % 5}) == 120

    once = corpus_pipeline.cut(stages["n-gram Jaccard join"](spark, good, f"file://{folder}"))
    assert once.columns == docs.columns
    left, before = rows_of(once), [x for x, n in kept.items() for _ in range(n)]
    assert left <= kept
    # each component before has one of the rows left; rows go by their place here, as ids are repeated
    groups = lambda rows: {c for _, n, c in components_of([(k, t) for k, (_, t) in enumerate(rows)]) if n}
    full = [x for x in left.elements() if shingles(x[1])]
    assert len(groups(full)) == len(full) == len(groups(before))
    assert sum(not shingles(t) for _, t in left.elements()) == sum(not shingles(t) for _, t in kept.elements())
    assert (7, dict.fromkeys(left) and next(t for i, t in left if i == 7)) in left and (300, None) not in left and not any(i == 300 for i, _ in left)

    clean = corpus_pipeline.cut(stages["benchmark decontamination"](spark, once, f"file://{folder}"))
    sets = [shingles(t) for _, t in items if shingles(t)]
    bad = {i for i, t in left if i is not None and any(100 * len(shingles(t) & s) >= 75 * len(s) for s in sets)}
    assert bad == {400, 401} and rows_of(clean) == collections.Counter({x: n for x, n in left.items() if x[0] not in bad}) and clean.columns == docs.columns

    safe = corpus_pipeline.cut(stages["secret scans"](spark, clean, f"file://{folder}"))
    assert safe.columns == docs.columns and rows_of(safe) == collections.Counter((i, secrets.redact(t)) for (i, t), n in rows_of(clean).items() for _ in range(n))
    assert not any(t and (KEY in t or "hunter2" in t) for _, t in rows_of(safe)) and all(r.n_chars == len(r.text) for r in safe.collect() if r.text is not None)

    t = library(word_bpe)
    want = collections.Counter()
    for (i, text), n in rows_of(safe).items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    last = stages["BPE encoding and decoding"](spark, safe, f"file://{folder}")
    assert collections.Counter(map(tuple, last.collect())) == want
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, f"file://{folder}").collect())) == want


def test_empty_tables(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"file://{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{folder}")
        assert out.count() == 0


def test_fit_takes_less_than_its_sample():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << quality.BITS, 10_000)).astype(np.uint32) for _ in range(800)]
    tracemalloc.start()
    quality.fit(sets, [k % 2 for k in range(800)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(s.nbytes for s in sets)


def test_the_join_lets_the_driver_collect_its_garbage(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ngram_jaccard, "collect_garbage", calls.append, raising=False)
    docs = spark.createDataFrame([(k, "one two three four five six seven") for k in range(3)], "doc_id long, text string")
    assert {r.component_id for r in ngram_jaccard.jaccard_components(docs).collect()} == {0}
    assert len(calls) >= ngram_jaccard.STAR_ROUNDS

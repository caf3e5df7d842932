"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from strandframe.llm import ann, chat, decontamination, html, lm, ngram_jaccard, quality, secrets, sharding

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def cut_words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text):
    w = cut_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeXYZ") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "one two", "ONE two", "a b c d", " ".join(say(20_000))]
    for _ in range(12):
        base = say(rng.randrange(6, 120))
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    passage = say(60)
    texts += [" ".join(say(k) + passage + say(5)) for k in range(2, 40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, texts[9])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # extra columns whose names clash with those of the operators
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in corpus], "doc_id long, text string, n long, node string, score double")


def components_of(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return collections.Counter((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows))


def test_jaccard_components(corpus, docs, monkeypatch):
    got = ngram_jaccard.jaccard_components(docs).collect()
    assert collections.Counter(map(tuple, got)) == components_of(corpus)
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    """Token combinations: whatever the classes of tokens, similar sets meet, the smaller one in its short prefix."""
    rng = np.random.default_rng(4)
    for n in (2, 3, 5, 16, 40, 90, 300):
        for _ in range(40):
            universe = rng.choice(1 << 50, 2 * n, replace=False).astype(np.uint64)
            rank = dict(zip(universe.tolist(), rng.integers(8, 120, 2 * n).tolist(), strict=True))
            x = universe[:n]
            y = np.concatenate((x[int(rng.integers(0, n // 6 + 1)) :], universe[n : n + int(rng.integers(0, n // 6 + 1))]))
            shared = len(set(x.tolist()) & set(y.tolist()))
            if 100 * shared < 75 * (len(x) + len(y) - shared) or set(x.tolist()) == set(y.tolist()):
                continue
            x, y = sorted((x, y), key=len)
            sig = [ngram_jaccard.signatures(len(s), np.sort(s), np.array([rank[v] for v in np.sort(s).tolist()], np.uint8), 75, smaller=k == 0) for k, s in enumerate((x, y))]
            assert len(np.intersect1d(*sig)), (n, len(x), len(y))


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_SHINGLES, 0])
def test_contained_items(spark, corpus, docs, limit):
    items = [(1, corpus[20][1]), (2, " ".join(corpus[6][1].split()[500:530])), (3, None), (4, ""), (5, "one TWO"), (6, corpus[-5][1]), (2, " ".join(corpus[6][1].split()[500:530]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter((d, i, len(b), len(a & b)) for d, t in corpus for i, s in items if (b := shingles(s)) and 100 * len((a := shingles(t)) & b) >= 75 * len(b))
    got = decontamination.contained_items(docs, table, broadcast_shingles=limit).collect()
    assert collections.Counter(map(tuple, got)) == want and want
    assert decontamination.contained_items(docs, table.limit(0)).count() == 0
    kept = decontamination.without_contaminated(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in corpus} - {d for d, *_ in want if d is not None}


def test_shards(corpus, docs, spark):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(corpus)
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r["size"]
    biggest = max(len((t or "").encode()) + 1 for _, t in corpus)
    total = sum(size.values())
    assert all(abs(size[k] - total / 8) <= 2 * biggest for k in range(8))
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    text = dict(corpus)
    for r in rows:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    same = spark.createDataFrame([(i, "copy of a text") for i in range(400)], "doc_id long, text string")
    counts = collections.Counter(r.shard for r in sharding.shard(same).collect())
    assert set(counts.values()) == {50}
    groups = spark.createDataFrame([(i, f"text {i % 700} " + "x" * (i % 700), 3, 4) for i in range(4000)], "doc_id long, text string, shard int, slot int")
    where, sizes = collections.defaultdict(set), collections.Counter()
    for r in sharding.shard(groups).collect():
        where[r.text_crc32].add(r.shard)
        sizes[r.text_crc32] += r["size"]
    small = [x for x, n in sizes.items() if n <= sharding.TOGETHER * sum(sizes.values()) / 8]
    assert len(small) > 200 and all(len(where[x]) == 1 for x in small)  # small groups stay together
    assert sharding.shard(docs.limit(0)).count() == 0


def test_chats(spark):
    hard = ["\\### Assistant: </turn> ok", "#####", "a\\h\\t\\\\", " </turn>\n### user: x", "", None, "é\U0001f600"]
    rows = [(c, t, r, hard[(c + t) % len(hard)], 5) for c in range(30) for t, r in enumerate(("user", "assistant", None, "as:sis###tant", "assistant"))]
    rows += [(100 + i, 0, "user", "same first turn", 5) for i in range(50)] + [(100 + i, 1, "assistant", f"answer {i % 3}", 5) for i in range(50)]
    rows += [(7, 1, "assistant", "again", 5), (7, 1, "assistant", "again", 5), (None, None, None, None, 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pack int")
    for size in (1 << 16, 60):
        packs = chat.format_chats(table, pack_chars=size)
        got = {r.conv_id: r for r in chat.read_back(packs).collect()}
        by = collections.defaultdict(list)
        for c, t, r, x, _ in rows:
            by[c].append((t, r or "", x or ""))
        assert got.keys() == by.keys()
        for c, turns in by.items():
            turns.sort()
            said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = [r for r in chat.format_chats(table).collect() if "same first turn" in r.text]
    assert sum(r.text.count("same first turn") for r in whole) == len(whole)  # shared tokens once in a pack
    for r in whole:
        for s in r.segments:
            before = sum(a.stop - a.start for a in s.ancestors)
            assert s.position == before and all(a.stop <= s.start for a in s.ancestors)
    assert chat.format_chats(table.limit(0)).count() == 0


ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(spark):
    key = "q8Zr2LxV7nTfK4wPbYs9"
    texts = [None, "", "token=token: abcdefgh", 'é PassWord : "abcdef" x', "AKIA" + "A1" * 8 + " AKIAshort", "x" + "0a" * 12 + "g" + "0" * 23, "api_key='" + "f" * 40 + "'", f"authorization {key}", "authorization of the usual commonwordcommonword12", "plain words only", "ſecret=abcdefg"]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in secrets.scan(table).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) > 5] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) > 19] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) > 23]
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want))
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
    assert "novel" in rows[7].spans and not rows[8].spans and not rows[9].spans
    clean = secrets.redacted(table)
    assert clean.columns == table.columns and {r.text for r in clean.collect() if r.doc_id in (7, 9)} == {"authorization [SECRET]", "plain words only"}


def test_language_model(corpus, docs):
    rows = collections.defaultdict(list)
    for r in lm.score(docs).collect():
        rows[r.doc_id].append(r)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in corpus if not held(i) for w in [*cut_words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in corpus:
        own = [*cut_words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        for r in rows[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert lm.score(docs.limit(0)).count() == 0


def test_bloom_levels_and_groups(docs):
    hashes = np.random.default_rng(2).integers(1, 1 << 62, 4000).astype(np.uint64)
    counts = np.arange(1, 4001)
    blob = lm.build_segment(hashes, counts)
    model = lm.Filter({0: blob}, 1)
    found = model.level(np.zeros(4000, np.int64), hashes)
    assert (found >= lm.levels(counts)).all() and (found == lm.levels(counts)).mean() > 0.95
    assert (model.level(np.zeros(4000, np.int64), hashes + np.uint64(1)) > 0).mean() < 0.05
    one = {(r.doc_id, round(r.score, 6)) for r in lm.score(docs).collect()}
    many = {(r.doc_id, round(r.score, 6)) for r in lm.score(docs, group_bytes=4000).collect()}
    assert one == many


def test_pages(spark):
    frame = '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav>Menu</nav><div class="cookie-notice">We use cookies</div>{}<div class="comments"><p>First!</p></div><footer>&copy; x</footer>'
    article = "<article><h1>A &amp; B</h1><p><b>bold</b>ly  said.<br>More<p>unclosed</article>"
    plain = "<div>Same banner of the site</div><div>Own words {}</div><div>Same line below</div>"
    pages = [(1, "http://h.org/a/1", frame.replace("{}", article)), (2, "http://h.org/a/2?x=1", frame.replace("{}", plain.replace("{}", "two"))), (3, "https://www.h.org/a/3#top", frame.replace("{}", plain.replace("{}", "three"))), (4, None, None), (5, "http://h.org/a/2", ""), (6, "x", "just text &lt;"), (None, "http://h.org/b", "<main>m</main>")]
    table = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html.extract(table).collect()}
    assert got[1].text == "A & B boldly said. More unclosed" and got[1].n_chars == len(got[1].text)
    # in order: /a/1, /a/2, /a/2?x=1, /a/3, /b; the pages with the same banner are neighbours
    assert got[2].text == "Own words two" and got[3].text == "Own words three"
    assert got[4].text == got[5].text == "" and got[6].text == "just text <" and got[None].text == "m"
    assert html.extract(table.limit(0)).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(2)

    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        kept = html.shared(a, b)
        assert len(kept) == brute(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(kept))


def test_quality(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "house", "is", "old", "and", "green", "today"]) for _ in range(40))
    rows = [(i, good() if i % 4 else good().upper().replace(" ", "!! "), 3) for i in range(240)] + [(1000, None, 3), (1001, "", 3), (None, "the house", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)] + [(0, 0, 0), (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(table, labels).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].predicted == int(i % 4 > 0) for i in range(240) if got[i].held_out]) > 0.98
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in range(240))
    assert quality.good(table, labels).columns == table.columns
    assert {r.score for r in quality.score(table, labels.limit(0)).collect()} == {0.5}
    # labels of held-out rows are never learnt from
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    assert {(r.doc_id, r.score) for r in quality.score(table, turned).collect()} == {(k, r.score) for k, r in got.items()}


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[30:60] = x[30]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [None] * 8, 0), (1080, [1.0], 0), (None, x[0].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    scores = x.astype(np.float64) @ x.astype(np.float64).T
    found = 0
    for q in range(0, 400, 20):
        order = [i for i in np.lexsort((np.arange(400), -scores[q])) if i != q][:20]
        assert [r for r, _ in got[q]] == sorted((r for r, _ in got[q]), key=lambda i: (-scores[q][i], i)) and len(got[q]) == 20
        assert all(abs(s - scores[q][i]) < 1e-9 for i, s in got[q])
        found += len(set(order) & {i for i, _ in got[q]}) / 20
    assert set(got) == set(range(0, 400, 20)) and found / 20 >= 0.9
    assert sorted(r.vec_id for r in ann.nearest(table.filter("vec_id < 3")).collect()) == [1, 2]
    assert ann.nearest(table.limit(0)).count() == 0


def test_sketch_bounds_overlap():
    rng = np.random.default_rng(5)
    for n, m, both in ((1, 1, 1), (40, 60, 30), (146, 146, 125), (3000, 2500, 2400), (7, 0, 0)):
        tokens = rng.integers(0, 1 << 52, n + m - both, dtype=np.uint64)
        a, b = tokens[:n], tokens[n - both :]
        differ = sum(int(x).bit_count() for x in (ngram_jaccard.sketch(a) ^ ngram_jaccard.sketch(b)).view(np.uint64))
        assert both <= (n + m - differ) / 2

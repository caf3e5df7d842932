import hashlib
import random
import unicodedata

import pyarrow.parquet as pq

from strandframe.llm import bpe

HARD = [None, "", " ", "Hello world's 123", "a<|endoftext|>B <|startoftext|>", "İstanbul ΣΑΣ ß", "été", "x" * 5000, "!?" * 3000, "a b\x1c c\x85d", "\U0001f600‍中文 ٣٤", "it'S we'LL 'dD"]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_same_ids_and_text_as_the_library(word_bpe):
    t, v = library(word_bpe), bpe.Vocabulary(word_bpe)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    rng = random.Random(3)
    every = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    low = [c for c in every if c < 0x3400]
    marks = [c for c in every if unicodedata.combining(chr(c))]
    own = [c for stated in (bpe.NO_LETTERS, bpe.NO_MARKS) for x, y in bpe._ranges(stated) for c in (x, y)] + [*bpe._small_letters()]
    kinds = [range(32, 127), low, every, marks, own, [0x20, 0x1F600]]
    texts += ["".join(chr(rng.choice(rng.choice(kinds))) for _ in range(200)) for _ in range(3000)]
    texts += [f"{x}{chr(c)}{y}" for c in [*low, *own] for x, y in ("ab", "12", "e\u0301", ".!")]
    for text in [*texts, *HARD[1:]]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert v.encode(text) == ids, text[:80]
        assert v.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_digests_and_columns(spark, word_bpe):
    t = library(word_bpe)
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(HARD)] + [(None, "a b", 7), (3, HARD[3], 7)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_digests(docs, word_bpe).collect()
    assert len(rows) == len(HARD) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        ids = t.encode(HARD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, word_bpe), word_bpe)
    assert back.count() == len(HARD) + 2
    assert bpe.encode_digests(docs.limit(0), word_bpe).count() == 0

"""BPE encoding and decoding with a public word-end vocabulary, by a contiguous rank array.

A word keeps the boundaries of its parts and, beside each, the merge rank of the two parts that meet there. The smallest
rank is found by a scan, its boundary deleted, and the two neighbouring ranks looked up again, until no pair has a rank.
Words over SHORT symbols take the same merges from a heap of (rank, place). The steps around it are those the
vocabulary file declares: special strings first, then NFC, white space to one space, lower case character by
character, the split into words, and the byte alphabet.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import words

#: Up to so many symbols the minimum is found by a scan.
SHORT = 96
#: Encoded words that are kept; then the memory starts anew.
REMEMBERED = 300_000
#: Texts that are Python strings at once.
TEXTS = 256
#: Fixed value: the white space of the vocabulary's patterns (the Unicode property of this name).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Where the library's Unicode tables are older or newer than those of Python. Code points in hexadecimal.
#: Letters and digits of other tables that are neither in the library's.
NO_LETTERS = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 "
    "16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Marks that the library's NFC neither moves nor composes.
NO_MARKS = (
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 11938 1193d-1193e 11943 119e0 11a34 11a47 "
    "11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
#: Capital letters, or ranges of them, and the first one's small letter.
CAPITALS = "1c89:1c8a a7cb:264 a7cc:a7cd a7ce:a7cf a7d2:a7d3 a7d4:a7d5 a7da:a7db a7dc:19b 10d50-10d65:10d70 16ea0-16eb8:16ebb"


def _ranges(stated: str) -> list[tuple[int, int]]:
    bounds = [[int(x, 16) for x in one.split("-")] for one in stated.split()]
    return [(b[0], b[-1]) for b in bounds]


def _class(stated: str) -> str:
    """The inside of a character class."""
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(stated))


def _small_letters() -> dict[int, int]:
    pairs = [one.split(":") for one in CAPITALS.split()]
    return {c: int(small, 16) + c - a for stated, small in pairs for a, b in _ranges(stated) for c in range(a, b + 1)}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merge ranks and patterns of a tokenizer file with word ends and no decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.end = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.space = regex.compile(f"[{SPACE}]+")
        split = next(x for x in whole["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        split = split.replace("\\s", SPACE)
        self.words = regex.compile(split)
        # where Unicode tables differ: the classes without what the library doesn't know, or with it
        known, other = f"[{SPACE}\\p{{L}}\\p{{N}}]", f"[{_class(NO_LETTERS)}]"
        careful = split.replace(f"[^{SPACE}\\p{{L}}\\p{{N}}]+", f"(?:{other}|(?!{known}).)+")
        self.careful = regex.compile(careful.replace("[\\p{L}]+", f"(?:(?!{other})\\p{{L}})+").replace("[\\p{N}]", f"(?!{other})\\p{{N}}"), regex.DOTALL)
        self.small = _small_letters()
        self.marks = regex.compile(f"([{_class(NO_MARKS)}]+)")
        self.differs = regex.compile(f"[{_class(NO_LETTERS + ' ' + NO_MARKS)}{''.join(map(chr, self.small))}]")
        self.alphabet = byte_alphabet()
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Parts of a word after all merges."""
        n = len(symbols)
        ranks, none = self.ranks, len(self.ranks)
        if n <= SHORT:
            parts = symbols
            adjacent = [ranks.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            while adjacent:
                least = min(adjacent)
                if least == none:
                    break
                i = adjacent.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del adjacent[i]
                if i < len(adjacent):
                    adjacent[i] = ranks.get((parts[i], parts[i + 1]), none)
                if i:
                    adjacent[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            return parts
        after, before, parts = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols)
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p]

    def word(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            symbols = [self.alphabet[b] for b in word.encode("utf-8")]
            symbols[-1] += self.end
            found = tuple(self.ids[p] for p in self.merge(symbols))
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(word) <= SHORT:
                self.seen[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split_special.split(text):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            pattern = self.words
            if not piece.isascii():
                if self.differs.search(piece):
                    pattern = self.careful
                    parts = self.marks.split(piece)  # marks are the odd ones
                    parts[::2] = [unicodedata.normalize("NFC", x) for x in parts[::2]]
                    piece = "".join(parts).translate(self.small)
                else:
                    piece = unicodedata.normalize("NFC", piece)
                piece = piece.replace("Σ", "σ")
            piece = self.space.sub(" ", piece).lower()
            for word in pattern.findall(piece):
                out += self.seen.get(word) or self.word(word)
        return out

    def decode(self, ids) -> str:
        """Strings of the tokens, joined by one space (the file declares no decoder); unknown ids are left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _texts(column: pa.Array):
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every whole text. Null and empty texts have none; each row gives a row."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = pa.array([v.encode(t or "") for t in _texts(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(words.freeing(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: both directions in one pass over the texts.

    Null and empty texts: 0 tokens and the digests of the empty string. Repeated rows are returned each.
    """

    def run(batches):
        v = vocabulary(path)
        numbers = {i: str(i) for i in v.strings}
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in _texts(batch.column(1)):
                ids = v.encode(text or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        v.seen.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(words.freeing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

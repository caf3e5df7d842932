"""Secrets in whole texts: fixed patterns, and strings that compress badly beside their surroundings.

The method's own spans come from dictionary-primed zstandard: a candidate string near a sensitive word is compressed as
a frame primed with the text around it and with dictionaries of words and identifiers. What the candidate adds to the
frame, as a share of what random strings of its length and alphabet add, is its novelty: words, identifiers and repeats
of nearby text add little, random keys almost all of their entropy. Nothing else decides.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The three patterns of the base, by kind in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make the text around them sensitive.
CONTEXT = re.compile(r"password|passwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization|signature|aws_", re.IGNORECASE | re.ASCII)
CONTEXT_WORDS = ("passw", "passphrase", "secret", "token", "api", "key", "credential", "bearer", "authorization", "signature", "aws_")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: The rest between lines of one block, and the short last line of a key block.
NEXT_LINE = re.compile(r"[\"',\\+\x20\t]*(?:\r?\n|\\n)[\"'>#*/\x20\t]*")
TAIL = re.compile(r"[\"'\x20\t]*(?:\r?\n|\\n)[\"'>#*/\x20\t]*([A-Za-z0-9+/_-]{0,15}={1,2}|[A-Za-z0-9+/_]{1,15}(?=[\"'\x20\t]*(?:\r?\n|\\n)[\"'>#*/\x20\t]*-----END))")
#: Characters between a sensitive word, or a secret, and a candidate on either side; those around it prime the compressor.
REACH = 64
AROUND = 400
#: A candidate that adds this share of what random strings of its alphabet add is reported.
NOVEL_SHARE = 0.8
#: Digits, hexadecimal, letters, base32, base36, and all key characters, in lower case.
ALPHABETS = ("0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: Fixed value: identifiers that fill the dictionary beside the surrounding text.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key credential credentials authorization "
    "bearer signature username user_name user_id client_id client_secret session_id request_id response config settings "
    "environment variable default example placeholder changeme your_key_here getElementById addEventListener document "
    "window function return const static public private class import export module require package version description "
    "https://www. http:// .com .org .net index.html application/json text/html charset=utf-8 content-type abcdefghijklmnop"
    "qrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 00000000 ffffffff deadbeef"
)

#: Fixed value: words and word parts that compound names are made of.
WORDS = (
    "about above access account action active address admin after agent alert allow amount analysis android answer apache append array asset async audio audit author auto available average back balance base batch before begin between binary block board boolean border bottom branch browser buffer build bundle business button cache call cancel "
    "category center certificate chain change channel char check child choice city class clean clear click clock close cloud cluster code collection color column command comment commit common company compile complete component compress condition connect connection console constant contact container content context continue control cookie copy core "
    "count counter country create current custom customer daily dashboard data database date debug decode deep default define delete delivery deploy description detail device dialog different digest direct directory disable display domain double download draft driver dynamic edit editor element email empty enable encode encrypt decrypt engine "
    "enter entity entry error event every exception exchange execute exist expire expiration export extension external factory fail failure false fast feature feedback fetch field file filter final find first flag float folder font footer force foreign form format forward found frame free from full future game gateway general generate generator "
    "global google graph group guard handle handler hash header health height hidden history home host hour icon image implementation increment information initial initialize inner input insert install instance integer integration interface internal international internationalization interval invalid invoice issue item iterator javascript job join kernel keyboard kind label language large last "
    "latest layer layout left length level library license limit line link list listener load local location lock logger login logout long loop machine mail main manage management manager manifest map mark market master match material maximum measure media member memory menu merge message metadata method metric micro middleware minimum minute mobile mode model modify "
    "module monitor month mount mouse move multi name native network never next node normal notification number object offset online only open operation operator option order origin output owner padding page panel parameter parent parse partial partner path pattern payment pending people percent performance permission person phone picture pipeline platform play plugin "
    "point policy pool popup port position post prefix preview previous price primary print priority process processor product profile program progress project property protocol provider proxy publish purchase python quality quantity query queue quick random range rating reader ready real receive recent record recovery redirect reference refresh region register registration "
    "relation release reload remote remove rename render replace reply report repository require reset resource rest result retry return review right role root round route router rule runtime sample save scale schedule scheduler schema scope score screen script scroll search second section security select selector send sensor sequence serial server service session setting setup shared "
    "shipping short show sign simple single site size skip small social software sort source space special speed stack standard start state static station status step stop storage store stream street string strong structure style subject submit subscribe subscription success suffix summary support switch symbol sync syntax system tab table target task team template temporary terminal test text theme "
    "thread threshold thumbnail ticket time timeout timestamp title toggle tool total track traffic transaction transfer transform translate transport tree trigger true type undefined under unique unit universal unknown unlock until update upgrade upload upper usage user utility valid validate validation validator value variable vendor verify verification version vertical video view "
    "virtual visible visit void wait wallet warning watch weather website week weight welcome widget width window wire with without word work worker workflow workspace world wrapper write writer year zone authenticate authentication authenticator authorize identity identifier credentials encryption decryption certificate signing rotation expiry invalid missing required optional policy provider "
    "/usr/local/share/lib/bin/etc/opt/var/log/tmp/home/src/main/java/resources/python/site-packages/node_modules/dist/build/docs/assets/images/ -------------------------------- ================================ ________________________________ //////////////////////////////// ation tion ment ness able ible ing ings ers ized izing ization ity ious ful less ally ence ance common word "
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _size(text: bytes, primer: bytes) -> int:
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text))


def _added(own: str, lead: str, around: str) -> int:
    """Bytes that ``own`` adds to a frame primed with the dictionaries and its surroundings."""
    primer, own, lead = ((x.lower()).encode("utf-8", "surrogatepass") for x in (f"{WORDS} {IDENTIFIERS}\n{around}", own, lead))
    return _size(lead + own, primer) - _size(lead, primer)


def _alphabet(word: str) -> str:
    """The smallest of ALPHABETS that holds a lower-case word."""
    return next(a for a in ALPHABETS if set(word) <= set(a))


@functools.lru_cache(4096)
def _random_added(alphabet: str, length: int) -> float:
    """Bytes that random strings of an alphabet add: the mean of a few."""
    rng = random.Random(f"{alphabet}:{length}")
    return sum(_added("".join(rng.choices(alphabet, k=length)), "", "") for _ in range(5)) / 5


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that text[start:end] adds to its primed frame, as a share of what random strings of its alphabet add.

    Case is left out on both sides. Copies of the candidate nearby are no surroundings: a key that stands twice is a key.
    """
    own = text[start:end]
    around = (text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND]).replace(own, " ")
    return _added(own, text[max(0, start - 16) : start], around) / _random_added(_alphabet(own.lower()), len(own))


def is_novel(text: str, start: int, end: int) -> bool:
    return novelty(text, start, end) >= NOVEL_SHARE


def _near(text: str, found: list[tuple[int, int]]) -> list[bool]:
    """Whether a candidate lies within REACH of a sensitive word, before or after it, or holds one."""
    contexts = [(m.start(), m.end()) for m in CONTEXT.finditer(text)]
    starts, ends = [c[0] for c in contexts], [c[1] for c in contexts]
    out = []
    for start, end in found:
        # the first word that ends at the candidate's reach or later is the only one to look at: words don't overlap
        k = bisect.bisect_left(ends, start - REACH)
        out.append(k < len(ends) and starts[k] <= end + REACH)
    return out


def _candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters, cut at the sensitive words in them (``my_api_key=...``)."""
    out = []
    for m in CANDIDATE.finditer(text):
        start = m.start()
        for word in CONTEXT.finditer(text, m.start(), m.end()):
            out.append((start, word.start()))
            start = word.end()
        out.append((start, m.end()))
    return [(a, b) for a, b in out if b - a >= LEAST]


def novel_spans(text: str) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = _candidates(text)
    near = _near(text, found)
    out, looked = set(), [False] * len(found)
    work = [k for k, x in enumerate(near) if x]
    while work:
        k = work.pop()
        if looked[k]:
            continue
        looked[k] = True
        start, end = found[k]
        novel = is_novel(text, start, end)
        if novel:
            out.add((start, 3, end))
            if tail := TAIL.match(text, end):
                out.add((tail.start(1), 3, tail.end(1)))
        # a secret carries the context on, and so does any line of a block to the next and the one before
        for other in (k - 1, k + 1):
            if 0 <= other < len(found) and not looked[other]:
                gap = text[found[other][1] : start] if other < k else text[end : found[other][0]]
                if (novel and len(gap) <= REACH) or NEXT_LINE.fullmatch(gap):
                    work.append(other)
    return sorted(out)


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: a novel one that lies inside a base span adds nothing and is left out."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, ends = [b[0] for b in base], list(itertools.accumulate((b[2] for b in base), max))
    inside = lambda x: (k := bisect.bisect_right(starts, x[0])) > 0 and ends[k - 1] >= x[2]
    return base, sorted(base + [x for x in novel_spans(text) if not inside(x)])


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row.

    Null and empty texts have no spans: zeros, the digest of the empty string and an empty string. Repeated rows give a
    row each; null ids stay null. Offsets are code points of the whole text.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base, whole = spans(text)
                kinds = [k for _, k, _ in base]
                for column, x in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(whole)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones as one) replaced."""
    found = spans(text)[1]
    if not found:
        return text
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced; all other columns and all rows stay."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([redact(t) for t in columns[place].to_pylist()], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

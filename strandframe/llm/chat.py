"""Chat formatting in prefix trees: conversations that share first turns share their tokens.

A node is a turn after its prefix. Conversations are put in order of their nodes' hashes, which is a depth-first order
of the tree, and cut into packs of bounded size. A pack emits each of its nodes once, depth first: `segments` holds for
each its place in the pack's text, its first position id (those of a segment run on from it), the intervals of its
ancestors, to which alone it may attend besides itself, and the interval of its trained text. A node whose subtree is
larger than a pack is emitted once in each pack. Tokens are code points.

Template: ``### role: text </turn>`` and a line feed for each turn. In roles and texts the control strings are escaped:
a backslash is two, ``###`` is ``\\h``, ``</turn>`` is ``\\t``; in roles a colon is ``\\c``.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import cut

#: A pack ends after so many code points or conversations.
PACK_CHARS = 1 << 16
PACK_CONVERSATIONS = 2048
#: Fixed value: the role that is trained.
TRAINED = "assistant"

_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ([^:]*): (.*?) </turn>\n", re.DOTALL)

CONVERSATION = "key binary, conv_id long, roles array<string>, texts array<string>, nodes array<binary>"
PACK = (
    "pack string, text string, "
    "segments array<struct<start:int,stop:int,position:int,ancestors:array<struct<start:int,stop:int>>,loss_start:int,loss_stop:int>>, "
    "conversations array<struct<conv_id:bigint,segment:int>>"
)


def escape(text: str, pattern=_IN_TEXT) -> str:
    return pattern.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def _conversations(batches):
    """Consecutive rows of one conversation to one row. Only one conversation is held at a time."""
    now, roles, texts = None, [], []
    seen = False
    out: list[tuple] = []

    def close():
        node, nodes = b"", []
        for role, text in zip(roles, texts, strict=True):
            node = hashlib.sha256(node + hashlib.sha256(role.encode()).digest() + hashlib.sha256(text.encode()).digest()).digest()[:16]
            nodes.append(node)
        out.append((b"".join(n[:8] for n in nodes), now, list(roles), list(texts), nodes))

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if seen and (conv_id != now or conv_id is None):
                close()
                roles, texts = [], []
            now, seen = conv_id, True
            roles.append(role or "")
            texts.append(text or "")
        if out:
            yield _rows(out)
            out = []
    if seen:
        close()
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "conv_id", "roles", "texts", "nodes"])


class _Pack:
    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.segments: list[dict] = []
        self.conversations: list[dict] = []
        self.path: list[tuple[bytes, int]] = []  # nodes of the last conversation and their segments

    def add(self, conv_id, roles, texts, nodes):
        depth = 0
        while depth < len(nodes) and depth < len(self.path) and self.path[depth][0] == nodes[depth]:
            depth += 1
        del self.path[depth:]
        for role, text, node in zip(roles[depth:], texts[depth:], nodes[depth:], strict=True):
            head = f"### {escape(role, _IN_ROLE)}: "
            body = escape(text)
            turn = f"{head}{body} </turn>\n"
            above = self.segments[self.path[-1][1]] if self.path else None
            ancestors = [*above["ancestors"], {"start": above["start"], "stop": above["stop"]}] if above else []
            # neighbours make one interval
            if len(ancestors) > 1 and ancestors[-2]["stop"] == ancestors[-1]["start"]:
                ancestors[-2:] = [{"start": ancestors[-2]["start"], "stop": ancestors[-1]["stop"]}]
            trained = role == TRAINED
            loss = self.size + len(head)
            self.segments.append({"start": self.size, "stop": self.size + len(turn), "position": above["position"] + above["stop"] - above["start"] if above else 0, "ancestors": ancestors, "loss_start": loss if trained else 0, "loss_stop": loss + len(body) if trained else 0})
            self.text.append(turn)
            self.size += len(turn)
            self.path.append((node, len(self.segments) - 1))
        self.conversations.append({"conv_id": conv_id, "segment": self.path[-1][1]})

    def row(self) -> pa.RecordBatch:
        text = "".join(self.text)
        first = self.conversations[0]
        name = hashlib.sha256(f"{first['conv_id']}:{text}".encode()).hexdigest()[:32]
        struct = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        segment = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("position", pa.int32()), ("ancestors", pa.list_(struct)), ("loss_start", pa.int32()), ("loss_stop", pa.int32())])
        conversation = pa.struct([("conv_id", pa.int64()), ("segment", pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text]), pa.array([self.segments], pa.list_(segment)), pa.array([self.conversations], pa.list_(conversation))], ["pack", "text", "segments", "conversations"])


def _packs(pack_chars: int):
    def run(batches):
        pack = _Pack()
        for batch in batches:
            for conv_id, roles, texts, nodes in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                pack.add(conv_id, roles, texts, nodes)
                if pack.size >= pack_chars or len(pack.conversations) >= PACK_CONVERSATIONS:
                    yield pack.row()
                    pack = _Pack()
        if pack.conversations:
            yield pack.row()

    return run


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs (pack, text, segments, conversations) of all conversations; see the module for their meaning.

    Rows of one id are one conversation, in order of turn (null first), then role and text: equal turns, and repeated
    rows, are turns each. Null roles and texts are empty; each row without an id is a conversation of its own. An empty
    table gives no packs. A conversation is never split, so a pack can be longer than ``pack_chars`` by one conversation.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # rows without an id are dealt out by what they hold
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    ordered = rows.repartition(parts, "conv_id", spread).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    whole = cut(ordered.mapInArrow(_conversations, CONVERSATION))
    return whole.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_packs(pack_chars), PACK)


def _read(text: str, segments: list[dict], starts: list[int], leaf: int) -> tuple[str, list[str]]:
    """The tokens that a leaf can attend to, in order of position, and the trained texts among them. starts: of the segments."""
    own = segments[leaf]
    spans = [*((a["start"], a["stop"]) for a in own["ancestors"]), (own["start"], own["stop"])]
    seen = (segments[k] for i, j in spans for k in range(bisect.bisect_left(starts, i), bisect.bisect_left(starts, j)))
    return "".join(text[i:j] for i, j in spans), [text[s["loss_start"] : s["loss_stop"]] for s in seen if s["loss_stop"]]


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for text, segments, conversations in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
            starts = [s["start"] for s in segments]
            for c in conversations:
                whole, losses = _read(text, segments, starts, c["segment"])
                turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(whole)]
                loss = "".join(unescape(x) for x in losses)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                values = (c["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
                for column, x in zip(out, values, strict=True):
                    column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def read_back(packs: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from packs alone."""
    return packs.mapInArrow(_read_back, READ)

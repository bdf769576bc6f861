"""Operator 3: chat formatting with typed content parts.

A conversation is rows (conversation, turn, role, parts); ``parts`` is an array
of typed content: text, image, audio, document. A visitor walks the parts of a
turn in order: text is escaped and copied, every attachment becomes a
placeholder ``<part kind=image n=1>`` numbered through the conversation, its
reference is recorded, and the tokens its placeholder stands for are counted
(image: tiles of its pixels; audio: frames of its seconds; document: its pages).

    <turn role="user">
    text and placeholders
    </turn>

The strings ``<turn``, ``</turn`` and ``<part `` are controls. Inside a text a
control is written with its run of preceding backslashes doubled and one more
put before it, so a control in the output is real exactly when no backslash
stands before it, and reading halves the run again: any text comes back as it was. A
newline closes each text before ``</turn>``, so a text's last backslash touches
no control. Roles are JSON strings.

A conversation is written by one task from rows sorted by turn as they stream
in, one conversation in memory at a time: it is one output row.

Defined results: rows of a conversation are ordered by turn (null first), then
role, then the parts, so ties and repeated rows give the same output whatever
their order; a null role or text is empty, null parts are none, an unknown
part kind is kept as an attachment of 0 tokens; rows with a null conversation
id form one conversation of their own; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.workers import map_arrow

PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,amount:double>"
CONTROL = re.compile(r"(\\*)(</?turn|<part )")
TURN = re.compile(r'<turn role=("(?:[^"\\]|\\.)*")>\n')
PLACEHOLDER = re.compile(r"(?<!\\)<part kind=(\w*) n=(\d+)>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


@dataclass
class Flattener:
    """Visitor over the parts of one conversation."""

    tile: int = 512          # pixels of an image tile's side
    tile_tokens: int = 170
    frames_per_second: float = 25.0
    page_tokens: int = 768
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part.get('kind')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        tiles = math.ceil((part.get("width") or 0) / self.tile) * math.ceil((part.get("height") or 0) / self.tile)
        return self._placeholder(part, max(1, tiles) * self.tile_tokens)

    def visit_audio(self, part: dict) -> str:
        return self._placeholder(part, math.ceil((part.get("amount") or 0) * self.frames_per_second))

    def visit_document(self, part: dict) -> str:
        return self._placeholder(part, math.ceil(part.get("amount") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> str:
        return self._placeholder(part, 0)

    def _placeholder(self, part: dict, tokens: int) -> str:
        kind = re.sub(r"\W", "_", part.get("kind") or "")
        self.attachments.append({"n": len(self.attachments) + 1, "kind": part.get("kind"), "ref": part.get("ref"),
                                 "tokens": tokens})
        return f"<part kind={kind} n={len(self.attachments)}>"


def text_parts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, parts) of rows that hold plain text: one text part each."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.col(text_col).alias("text"), none.cast("string").alias("ref"),
                    none.cast("bigint").alias("width"), none.cast("bigint").alias("height"),
                    none.cast("double").alias("amount"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens): one row a conversation.

    ``loss_spans`` are the code point ranges [start, end) of the formatted text
    that hold ``loss_role``'s contents; ``expanded_tokens`` sums the attachments'.
    """

    def write(conv, rows: list[dict]) -> dict:
        visitor, out, at, spans = Flattener(), [], 0, []
        for r in rows:
            role = r["role"] or ""
            head = f"<turn role={json.dumps(role, ensure_ascii=False)}>\n"
            body = "".join(visitor.visit(p) for p in r["parts"] or [] if p)
            if role == loss_role:
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            out.append(f"{head}{body}\n</turn>\n")
            at += len(out[-1])
        return {"conv_id": conv, "formatted": "".join(out), "loss_spans": spans,
                "attachments": visitor.attachments,
                "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)}

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attachment = pa.list_(pa.struct([("n", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                                     ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, done, held, conv, size = None, [], [], None, 0
        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("formatted", pa.string()),
                                          ("loss_spans", span), ("attachments", attachment),
                                          ("expanded_tokens", pa.int64())])
            for r in b.to_pylist():
                if held and r["conv_id"] != conv:
                    done.append(write(conv, held))
                    size += len(done[-1]["formatted"])
                    held = []
                conv = r["conv_id"]
                held.append(r)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done, size = [], 0
        if held:
            done.append(write(conv, held))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = (turns.select("conv_id", "turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts"))
    return map_arrow(ordered, run,
                     f"conv_id {kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, "
                     "attachments array<struct<n:bigint,kind:string,ref:string,tokens:bigint>>, "
                     "expanded_tokens bigint")


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; placeholders stay in the text."""
    out, at = [], 0
    while at < len(formatted):
        head = TURN.match(formatted, at)
        if not head:
            raise ValueError("a turn does not begin where the last one ended")
        # The closing control follows a newline; one inside a text follows a backslash.
        end = formatted.index("\n</turn>\n", head.end())
        out.append((json.loads(head[1]), unescape(formatted[head.end():end])))
        at = end + len("\n</turn>\n")
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text holds when it is parsed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                turns = parse_turns(r["formatted"])
                whole, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                for s in r["loss_spans"]:
                    text = unescape(r["formatted"][s["start"]:s["end"]])
                    loss.update(text.encode())
                    loss_chars += len(text)
                out.append((r["conv_id"], len(turns), whole.hexdigest(), loss_chars, loss.hexdigest(),
                            len(r["formatted"]), len(r["attachments"]), r["expanded_tokens"]))
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                     pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
                "n_attachments", "expanded_tokens"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_arrow(formatted.select("conv_id", "formatted", "loss_spans", "attachments", "expanded_tokens"), run,
                     f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                     "formatted_chars bigint, n_attachments bigint, expanded_tokens bigint")

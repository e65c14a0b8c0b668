r"""Operator 8: chat formatting of conversations with typed content parts.

A turn is written as `### role: content</turn>` and a line end. Inside texts and roles the characters that could build a
control string are escaped: `\` as `\b`, `<` as `\l`, `#` as `\h`, and in roles `:` as `\c`; so a `#` or `<` in the
output is always the template's own, and unescaping is exact. A visitor walks a turn's parts in order: text is
escaped, and an image, audio clip or document becomes a placeholder `<|image 1|>`, numbered through the conversation,
with an attachment record of its kind, reference and the tokens it will expand to. A document's own parts follow its
placeholder. The loss mask covers the text of assistant turns: spans of code points, placeholders left out.

Turns are ordered by turn, null first, and for equal turns by role and content. Null text is empty and still a turn; a
null role is the empty role; rows with a null conversation id form one conversation. Repeated rows are repeated turns.
Unknown part types become placeholders of no tokens. Typed content that isn't a JSON list is one text, parts that aren't
objects are texts, and sizes that aren't numbers count as 0. Extra columns are ignored. No rows give no conversations.
Turns reach their conversation through a partial collect; one conversation is one output row, so it must fit a row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
#: Tokens of attachments: pixels of one image patch side, audio tokens a second, tokens a document page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 256
SCHEMA = "formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<ordinal:int,kind:string,reference:string,tokens:long>>, expanded_tokens long"


def escape(text: str, role: bool = False) -> str:
    for plain, code in _ESCAPES:
        text = text.replace(plain, code)
    return text.replace(":", "\\c") if role else text


def unescape(text: str) -> str:
    for plain, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = text.replace(code, plain)
    return text


class Visitor:
    """Flattens the parts of one conversation's turns; `visit` dispatches on a part's type."""

    def __init__(self, learn_from: Iterable[str] = ("assistant",)):
        self.out: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []
        self.learn_from, self.learning = set(learn_from), False

    def write(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def turn(self, role: str | None, parts: list[dict]) -> None:
        self.write(OPEN + escape(role or "", role=True) + AFTER_ROLE)
        self.learning = role in self.learn_from
        for part in parts:
            self.visit(part)
        self.learning = False
        self.write(CLOSE)

    def visit(self, part: dict | str) -> None:
        part = part if isinstance(part, dict) else {"type": "text", "text": _string(part)}
        kinds = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        kinds.get(part.get("type") if isinstance(part.get("type"), str) else "", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        start = self.at
        self.write(escape(_string(part.get("text"))))
        if self.learning and self.at > start:
            if self.spans and self.spans[-1][1] == start:
                self.spans[-1] = (self.spans[-1][0], self.at)
            else:
                self.spans.append((start, self.at))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((len(self.attachments) + 1, kind, None if part.get("ref") is None else _string(part["ref"]), tokens))
        self.write(f"<|{escape(kind)} {len(self.attachments)}|>")

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil(_number(part, "width") / PATCH) * math.ceil(_number(part, "height") / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(_number(part, "seconds") * PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, math.ceil(_number(part, "pages")) * PER_PAGE)
        inner = part.get("parts")
        for each in inner if isinstance(inner, list) else ():
            self.visit(each)

    def visit_other(self, part: dict) -> None:
        self.attach(str(part.get("type")), part, 0)


def parts_of(content: str | None, typed: bool) -> list[dict]:
    """A turn's parts: plain content is one text; typed content is a JSON list of parts (or of strings), and one text where it isn't."""
    if typed:
        try:
            parts = json.loads(content or "[]")
        except (ValueError, RecursionError):
            parts = None
        if isinstance(parts, list):
            return parts
    return [{"type": "text", "text": content or ""}]


def _number(part: dict, name: str) -> float:
    """A size that a part tells; 0 where it tells none, or something else than a finite number of 0 or more."""
    value = part.get(name)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value < 2**40 else 0


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def format_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", typed: bool = False) -> DataFrame:
    """(conversation, formatted, loss_spans, attachments, expanded_tokens), one row per conversation."""
    kind = rows.schema[conversation].dataType.simpleString()
    turns = rows.select(F.col(conversation).alias("__conv"), F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(content).cast("string").alias("content")).alias("t"))
    grouped = turns.groupBy("__conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches):
        for batch in batches:
            made = []
            for turns in batch.column(1).to_pylist():
                v = Visitor()
                for t in turns:
                    v.turn(t["role"], parts_of(t["content"], typed))
                made.append(v)
            spans = pa.array([[{"start": a, "end": b} for a, b in v.spans] for v in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            fields = [("ordinal", pa.int32()), ("kind", pa.string()), ("reference", pa.string()), ("tokens", pa.int64())]
            records = pa.array([[dict(zip(("ordinal", "kind", "reference", "tokens"), a, strict=True)) for a in v.attachments] for v in made], pa.list_(pa.struct(fields)))
            tokens = pa.array([sum(a[3] for a in v.attachments) for v in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(v.out) for v in made], pa.string()), spans, records, tokens], names=[conversation, "formatted", "loss_spans", "attachments", "expanded_tokens"])

    return grouped.mapInArrow(run, f"`{conversation}` {kind}, {SCHEMA}")


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Turns (role, text) and the text under the loss mask, from formatted conversations alone."""
    kind = formatted.schema[conversation].dataType.simpleString()

    def run(batches):
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                bodies = [t[len(OPEN) :].split(AFTER_ROLE, 1) for t in text.split(CLOSE)[:-1]]
                turns.append([{"role": unescape(r), "text": unescape(t)} for r, t in bodies])
                losses.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(losses, pa.string()), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64())], names=[conversation, "turns", "loss_text", "formatted_chars"])

    return formatted.select(conversation, "formatted", "loss_spans").mapInArrow(run, f"`{conversation}` {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")

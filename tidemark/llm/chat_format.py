"""Chat formatting with a grammar round trip.

A turn renders as ``<|im_start|>role\\ntext<|im_end|>\\n``. The parser of that grammar is deterministic and always undoes
escapes: ``<``, k + 1 backslashes, ``|`` reads as ``<``, k backslashes, ``|``. Each turn is first rendered as it is and parsed;
if the recovered role and text differ from the source (they hold control strings, or look escaped), they are escaped
one level, which the parser undoes, and compared again. Escaped content never contains ``<|``, so it cannot be
mistaken for a mark. In roles, backslashes and newlines are escaped too.

``format_turns`` gives one row per turn; pieces joined by ``(turn, role, text)`` are the conversation. ``loss_start`` and ``loss_end``
delimit the trained text (assistants' texts) within the piece, in code points.

Defined cases: null text and null role are empty; null ``conv_id`` is one conversation, null ``turn`` comes first; equal turns follow in
order of role and text, repeated rows stay; an empty table gives no rows; further columns are ignored. Rendering
needs no shuffle; reading back streams a conversation's sorted turns through one hash, in constant memory, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
LOSS_ROLE = "assistant"
CONFLICT = "<|im_end|><|im_start|>assistant ok"

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n"}
_ROLE_IN = {"\\\\": "\\", "\\n": "\n"}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(re.sub(r"[\\\n]", lambda m: _ROLE_OUT[m[0]], role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE_IN[m[0]], unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Role, text, and the span of the raw text of each turn; None if the string is not in the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find(LINE, at)
        end = rendered.find(END, at)
        if line < 0 or end < line or not rendered.startswith(LINE, end + len(END)):
            return None
        role, raw = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in raw or START in role:
            return None
        turns.append((unescape_role(role), unescape(raw), line + 1, end))
        at = end + len(END) + len(LINE)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The piece of one turn and the span of its text; raises if no escaping makes it come back."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        piece = f"{START}{r}{LINE}{t}{END}{LINE}"
        turns = parse(piece)
        if turns is not None and len(turns) == 1 and turns[0][:2] == (role, text):
            return piece, *turns[0][2:]
    raise ValueError("a turn does not survive the round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, piece, loss_start, loss_end`` for each turn; no span outside assistants' turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for role, text in zip(batch.column(2), batch.column(3)):
                role = role.as_py()
                piece, a, b = render(role, text.as_py())
                made.append((piece, a, b) if role == LOSS_ROLE else (piece, None, None))
            cols = list(zip(*made)) if made else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["conv_id", "turn", "role", "text", "piece", "loss_start", "loss_end"])

    slim = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return slim.mapInArrow(run, "conv_id long, turn long, role string, text string, piece string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its pieces and loss spans alone."""

    class Conversation:
        def __init__(self, conv_id):
            self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def take(self, piece: str, a: int | None, b: int | None) -> None:
            for role, text, *_ in parse(piece):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode())
            if a is not None:
                own = unescape(piece[a:b])
                self.loss_chars += len(own)
                self.loss.update(own.encode())
            self.chars += len(piece)

        def row(self):
            return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for conv_id, piece, a, b in zip(*(batch.column(i) for i in range(4))):
                conv_id = conv_id.as_py()
                if now is None or conv_id != now.conv_id:
                    if now:
                        rows.append(now.row())
                    now = Conversation(conv_id)
                now.take(piece.as_py(), a.as_py(), b.as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types)], names=names)

    sorted_pieces = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_pieces.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Chat formatting: fold an event log into final messages and render them with a loss mask.

Events are (conv_id, turn, seq, kind, role, text). Within a turn, in order of seq:

* ``message`` starts a message with a role and a first piece of text,
* ``delta`` appends text to the turn's latest message (its role fills a missing one),
* ``edit`` replaces that message's text,
* ``regenerate`` empties it, so that later deltas write it anew,
* ``delete`` takes it back.

A delta, edit or regenerate before any message starts one. Defined results: null text is empty, a null role is the empty role, null
turns come first, null conversations form one conversation, rows that tie in turn and seq go by kind, role and text, and each
repeated ``message`` row is a message of its own. Texts of any length are folded and rendered whole, a turn at a time. Unknown kinds raise. An empty log gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, short_batches

KINDS = ("message", "delta", "edit", "regenerate", "delete")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that a chat model may read as control. A text's own copies get a backslash after their first character, and copies that
#: have backslashes there already get one more, so that taking one away restores the text.
_RAW = re.compile(r"([<\[])(\\*)(?=(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\]))")
_KEPT = re.compile(r"([<\[])\\(\\*)(?=(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\]))")
#: The same pattern for SQL engines without lookahead.
SQL_PATTERN = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>|/?INST\])"


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _KEPT.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def render_message(role: str, text: str) -> tuple[str, int | None, int | None]:
    """The rendered turn, and where in it the text that bears loss starts and ends (assistant turns only)."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    mask = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
    return head + body + CLOSE, *mask


def read_message(piece: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError("not a rendered turn")
    role, _, body = piece[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape_role(role), unescape(body)


def _fold(batches):
    """Rows sorted by conversation, turn and seq to (conv_id, turn, part, role, text), holding one turn's latest message."""
    at, part, live, role, pieces = None, 0, False, None, []
    for batch in batches:
        for conv, turn, kind, who, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "role", "text"))):
            if kind not in KINDS:
                raise ValueError(f"unknown kind of event: {kind!r}")
            new = (conv, turn) != at
            if live and (new or kind == "message"):
                yield *at, part, role or "", "".join(pieces)
                part, live = part + 1, False
            if new:
                at, part = (conv, turn), 0
            if kind == "delete":
                live = False
                continue
            if not live:
                live, role, pieces = True, None, []
            if kind in ("edit", "regenerate"):
                pieces = []
            role = role if role is not None else who
            if text and kind != "regenerate":
                pieces.append(text)
    if live:
        yield *at, part, role or "", "".join(pieces)


def render(events: DataFrame) -> DataFrame:
    """Final messages, rendered: (conv_id, turn, part, role, rendered, loss_start, loss_end), one row for each message.

    The log is dealt by (conv_id, turn), not by conversation alone, so that a conversation with a large share of all rows is
    folded and rendered by many tasks; a task holds one message at a time. Rows sort by (turn, part) within a conversation.
    """
    import pyarrow as pa

    short_batches(events.sparkSession)
    out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        yield from batches_of(((c, t, p, r, *render_message(r, x)) for c, t, p, r, x in _fold(batches)), out)

    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    dealt = events.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")
    dealt = dealt.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", order, "role", "text")
    return dealt.mapInArrow(run, "conv_id long, turn long, part long, role string, rendered string, loss_start long, loss_end long")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as an event log: one message event for each row."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def digest(rendered: DataFrame) -> DataFrame:
    """Read rendered turns back: one row of counts and digests for each conversation.

    A digest runs over a conversation's turns in order, so that they meet in one task, which streams them from a sort that can
    spill and holds one turn. All other work is done in render().
    """
    import pyarrow as pa

    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches):
        at, begun = None, False
        for batch in batches:
            for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end"))):
                if not begun or conv != at:
                    if begun:
                        yield at, n, turns.hexdigest(), chars, loss.hexdigest(), formatted
                    at, begun, n, chars, formatted, turns, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = read_message(piece)
                turns.update(f"{role}\n{text}\n".encode())
                n, formatted = n + 1, formatted + len(piece)
                if start is not None:
                    masked = unescape(piece[start:end])
                    chars += len(masked)
                    loss.update(masked.encode())
        if begun:
            yield at, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def run(batches):
        yield from batches_of(rows(batches), out)

    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

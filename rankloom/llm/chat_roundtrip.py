"""Chat formatting by grammar round trip: render turns, reparse them deterministically, escape what conflicts until both agree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|esc|>"
_GROW, _SHRINK, _ROLE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|"), re.compile(r"[%<\n\r]")
SCHEMA = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>, roles array<string>, texts array<string>"


def escape(text: str) -> str:
    """One more backslash between every < and |: no control string is left, and unescape() takes exactly that one away."""
    return _GROW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHRINK.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return _ROLE.sub(lambda m: f"%{ord(m[0]):02X}", role)


def _role_in(role: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), role)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the span of each turn's text in it."""
    out, spans, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head = f"{START}{_role_out(role)}{ESCAPED if i in escaped else ''}\n"
        body = escape(text) if i in escaped else text
        out += [head, body, END, "\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start, end of the raw text); None if the grammar does not hold.

    formatted := turn*;  turn := START role [ESCAPED] newline body END newline;  body has neither START nor END.
    """
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            return None
        nl = formatted.find("\n", at)
        end = formatted.find(END, nl + 1) if nl >= 0 else -1
        if end < 0 or formatted[end + len(END) : end + len(END) + 1] != "\n" or 0 <= formatted.find(START, nl + 1, end):
            return None
        role, body = formatted[at + len(START) : nl], formatted[nl + 1 : end]
        if role.endswith(ESCAPED):
            role, text = role[: -len(ESCAPED)], unescape(body)
        else:
            text = body
        turns.append((_role_in(role), text, nl + 1, end))
        at = end + len(END) + 1
    return turns


def round_trip(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Renders, reparses and escapes the turns that do not come back alone, until the whole comes back identical."""
    escaped: set[int] = set()
    while True:
        formatted, _ = render(turns, escaped)
        back = parse(formatted)
        if back is not None and [(r, t) for r, t, *_ in back] == turns:
            return formatted, back
        more = {i for i, t in enumerate(turns) if i not in escaped and (b := parse(render([t], set())[0])) is None or i not in escaped and [(x[0], x[1]) for x in b] != [t]}
        more = more or {i for i in range(len(turns)) if i not in escaped}
        if not more:
            raise ValueError("the grammar cannot express these turns")
        escaped |= more


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: the formatted text, the loss mask's spans in it, and roles and texts as read back from it.

    Rows (conv_id, turn, role, text); turns in order of turn, ties by role, then text; repeated rows are repeated turns. Null
    role or text: empty. A null conv_id is a conversation of its own. Extra columns are ignored; empty input gives no rows. A
    conversation is one formatted text, so it has to fit one row; nothing else gathers.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for turns in b.column(1).to_pylist():
                formatted, back = round_trip([(t["role"], t["text"]) for t in turns])
                out.append((len(back), formatted, [{"start": s, "end": e} for r, _, s, e in back if r == loss_role], [x[0] for x in back], [x[1] for x in back]))
            n, f, spans, roles, texts = zip(*out, strict=True) if out else ((),) * 5
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f, pa.string()), pa.array(spans, span), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], names=["conv_id", "n_turns", "formatted", "loss_spans", "roles", "texts"])

    return chats.mapInArrow(run, SCHEMA)

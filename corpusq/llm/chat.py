"""Chat formatting with a grammar round trip.

A conversation is rendered as

    user        <s>[INST] TEXT [/INST]
    assistant   <s> TEXT</s>
    other       <s>[ROLE=name] TEXT [/ROLE]

one segment a turn, segments following each other without anything between. The grammar is
deterministic: a segment starts with `<s>`, its head names the role, and its text ends at the first
closing mark of that role that isn't escaped. A backslash followed by a backslash, `<` or `[` stands
for that character; any other backslash stands for itself.

A turn is first rendered as it is and parsed again; if the parser doesn't give back the same role
and text and stop at the segment's end, the turn's text is escaped and the check repeated: first
only its closing marks and the backslashes before a special character, then every backslash, `<`
and `[`. The last form always parses back. What is returned is read back from the rendered text.

Turns are ordered by (turn, role, text), nulls first, so ties have one order. Each conversation is
streamed through one task: its formatted text is parsed back in stretches of whole turns, and the digests
are updated as they pass, so a conversation of any length needs the memory of a stretch or of one turn.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; repeated
rows are repeated turns; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.batches import text_bytes

HEADS = re.compile(r"<s>(?:(\[INST\] )|\[ROLE=((?:\\[\\<\[\]]|[^\\\]])*)\] |( ))", re.S)
CLOSING = {"user": " [/INST]", "assistant": "</s>"}
OTHER = " [/ROLE]"
READ_CHARS = 1 << 16
SPECIAL = re.compile(r"[\\<\[]")
ESCAPED = re.compile(r"\\([\\<\[])")
ESCAPED_NAME = re.compile(r"\\([\\<\[\]])")


def escape_little(text: str, closing: str) -> str:
    """Backslashes before a special character, and closing marks."""
    text = re.sub(r"\\(?=[\\<\[])", r"\\\\", text)
    mark = closing.lstrip()
    return text.replace(mark, "\\" + mark)


def escape_all(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def render(role: str, text: str) -> str:
    """The segment of a turn whose text is already escaped, or needs no escape."""
    if role == "user":
        return f"<s>[INST] {text}{CLOSING[role]}"
    if role == "assistant":
        return f"<s> {text}{CLOSING[role]}"
    name = re.sub(r"[\\<\[\]]", lambda m: "\\" + m[0], role)
    return f"<s>[ROLE={name}] {text}{OTHER}"


def parse(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, start and end of the text as rendered, end of the segment) of the segment at `at`."""
    m = HEADS.match(rendered, at)
    if not m:
        raise ValueError(f"no segment at {at}")
    role = "user" if m[1] else "assistant" if m[3] else ESCAPED_NAME.sub(r"\1", m[2])
    closing = CLOSING.get(role if m[2] is None else "", OTHER)
    i = m.end()
    ends = re.compile(r"\\[\\<\[]|" + re.escape(closing), re.S)
    while found := ends.search(rendered, i):
        if found[0] == closing:
            return role, ESCAPED.sub(r"\1", rendered[m.end() : found.start()]), m.end(), found.start(), found.end()
        i = found.end()
    raise ValueError(f"the segment at {at} has no end")


def parse_all(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    at, out = 0, []
    while at < len(rendered):
        role, text, _, _, at = parse(rendered, at)
        out.append((role, text))
    return out


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """(rendered, role, text): the least escaped form that parses back, and what was parsed from it."""
    closing = CLOSING.get(role, OTHER)
    for form in (lambda: text, lambda: escape_little(text, closing), lambda: escape_all(text)):
        rendered = render(role, form())
        try:
            got_role, got_text, _, _, end = parse(rendered)
        except ValueError:
            continue
        if (got_role, got_text, end) == (role, text, len(rendered)):
            return rendered, got_role, got_text
    raise AssertionError("an escaped turn always parses back")


class _Digest:
    """The results of one conversation, read back from its formatted text.

    Segments are put together until READ_CHARS of formatted text wait; that stretch is parsed from its start, segment by segment,
    and the text under the loss mask is cut out by its span.
    """

    def __init__(self, conv) -> None:
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss, self.text = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.waiting: list[str] = []
        self.size = 0

    def add(self, role: str, text: str) -> None:
        rendered = format_turn(role, text)[0]
        self.waiting.append(rendered)
        self.size += len(rendered)
        if self.size >= READ_CHARS:
            self.read()

    def read(self) -> None:
        formatted, at = "".join(self.waiting), 0
        self.waiting, self.size = [], 0
        self.chars += len(formatted)
        self.text.update(formatted.encode())
        while at < len(formatted):
            role, text, start, end, at = parse(formatted, at)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = ESCAPED.sub(r"\1", formatted[start:end])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())

    def row(self) -> tuple:
        self.read()
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.text.hexdigest()


def _ordered(turns: DataFrame) -> DataFrame:
    cols = turns.select("conv_id", "turn", "role", "text")
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the rendered segment of every turn, with the span that bears loss.

    loss_start and loss_end are code points within the segment, null for turns without loss. A
    conversation's formatted text is its segments in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, start, end = [], [], []
            for role, text in zip(text_bytes(b.column(2)), text_bytes(b.column(3))):
                rendered, role, _ = format_turn(role.decode("utf-8", "replace"), text.decode("utf-8", "replace"))
                span = parse(rendered)[2:4] if role == "assistant" else (None, None)
                out.append(rendered)
                start.append(span[0])
                end.append(span[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"])

    kinds = dict(turns.dtypes)
    return _ordered(turns).mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, rendered string, loss_start long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted_sha256"])

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), text_bytes(b.column(2)), text_bytes(b.column(3))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(role.decode("utf-8", "replace"), text.decode("utf-8", "replace"))
            if len(done) > 5000:
                yield out()
                done.clear()
        if now is not None:
            done.append(now.row())
        if done:
            yield out()

    frame = _ordered(turns.withColumn("conv_id", F.col("conv_id").cast("long")))
    return frame.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string")

"""Chat formatting by grammar round trip.

A turn is rendered as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``. The
rendered text is parsed again by a deterministic parser and compared with its
source; while they differ, what conflicts is escaped and the turn rendered anew:

- control strings in a role or text, and what already looks like an escaped one,
  get one more backslash behind their ``<``; the parser takes one off;
- a line break in a role becomes ``<|nl|>``.

Control strings begin with the only ``<`` and end with the only ``>`` they hold,
so none can arise where texts meet them, and turns that come back alone come
back in a row.

``format`` range-partitions turns by conversation and order, so that a
conversation with a third of all turns is rendered by many tasks; each range
writes a conversation as one row, or as numbered parts of about ``PART_CHARS``.
Rows have the formatted text and the loss mask: spans, in code points, of the
assistant's texts. ``read_back`` parses whole conversations where they lie; only
those that may go on in another row are brought together, and stream through one
task in order, since a digest has to see its bytes in order.

Defined results: null roles and texts are empty; turns go by ``turn`` (null
first), ties by role, then text; repeated rows are turns of their own; rows
without ``conv_id`` are one conversation; an empty table gives no rows. Input
columns other than the four are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen.llm.base import whole_text, written

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PART_CHARS = 1 << 20
KEY_CHARS = 64  # of a text that tell tied turns' ranges apart
_TEXT = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ROLE = re.compile(r"<(\\*)\|(im_start|im_end|nl)\|>")
_BREAK = "<|nl|>"


class GrammarError(ValueError):
    """Text that no sequence of turns renders to."""


def escape(role: str, text: str) -> tuple[str, str]:
    more = r"<\1\\|\2|>"
    return _ROLE.sub(more, role).replace("\n", _BREAK), _TEXT.sub(more, text)


def _less(match: re.Match) -> str:
    slashes, name = match.groups()
    return f"<{slashes[1:]}|{name}|>" if slashes else "\n" if name == "nl" else match[0]


def unescape(text: str) -> str:
    return _TEXT.sub(_less, text) if "<\\" in text else text


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, first, last) of each turn; text is formatted[first:last], unescaped."""
    at = 0
    while at < len(formatted):
        head = at + len(START)
        line, end = formatted.find("\n", head), formatted.find(END, head)
        if not formatted.startswith(START, at) or line < 0 or end < line or not formatted.startswith("\n", end + len(END)):
            raise GrammarError(f"no turn at {at}")
        if formatted.find(START, head, end) >= 0:
            raise GrammarError(f"a turn inside the turn at {at}")
        role = formatted[head:line]
        yield _ROLE.sub(_less, role) if "<" in role else role, unescape(formatted[line + 1:end]), line + 1, end
        at = end + len(END) + 1


def settle(role: str, text: str) -> str:
    """The turn rendered so that parsing gives exactly it: escaped while it does not."""
    own = role, text
    while True:
        turn = render(*own)
        try:
            if [t[:2] for t in parse(turn)] == [(role, text)]:
                return turn
        except GrammarError:
            pass
        more = escape(role, text)
        if more == own:
            raise GrammarError("a turn that escaping cannot keep")
        own = more


_FORMATTED = "conv_id {}, range int, part int, whole boolean, formatted string, loss array<struct<first: int, last: int>>"


class _Part:
    def __init__(self, conv, number: int):
        self.conv, self.number, self.turns, self.loss, self.size = conv, number, [], [], 0

    def add(self, role: str, text: str) -> None:
        turn = settle(role, text)
        if role == ASSISTANT:
            _, _, first, last = next(parse(turn))
            self.loss.append({"first": self.size + first, "last": self.size + last})
        self.turns.append(turn)
        self.size += len(turn)

    def row(self, range_: int, whole: bool) -> dict:
        return {"conv_id": self.conv, "range": range_, "part": self.number, "whole": whole, "formatted": "".join(self.turns), "loss": self.loss}


def _formatting(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("range", pa.int32()), ("part", pa.int32()), ("whole", pa.bool_()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range's sorted turns; ``whole`` is false where the conversation may go on in another row."""
        part, first, range_ = None, True, 0
        rows, held = [], 0
        for batch in batches:
            for range_, conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or conv != part.conv:
                    if part is not None:
                        rows.append(part.row(range_, not first and part.number == 0))
                        held += part.size
                        first = False
                    part = _Part(conv, 0)
                elif part.size > PART_CHARS:
                    rows.append(part.row(range_, False))
                    held += part.size
                    part = _Part(conv, part.number + 1)
                part.add(role, text)
                if held > PART_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if part is not None:
            rows.append(part.row(range_, False))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def format(turns: DataFrame) -> DataFrame:
    """Formatted conversations (conv_id, range, part, whole, formatted, loss) of ``turns`` (conv_id, turn, role, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = turns.schema["conv_id"].dataType
    turns = turns.select("conv_id", "turn", whole_text("role").alias("role"), whole_text("text").alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, KEY_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered = dealt.select(F.spark_partition_id().alias("range"), "conv_id", "role", "text")
    return ordered.mapInArrow(_formatting(to_arrow_type(field)), _FORMATTED.format(field.simpleString()))


DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv, whole: bool):
        self.conv, self.whole = conv, whole
        self.turns = self.loss = self.size = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            text = unescape(formatted[span["first"]:span["last"]])
            self.loss += len(text)
            self.masked.update(text.encode("utf-8", "surrogatepass"))
        self.size += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.size


def _reading(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for batch in batches:
            for conv, whole, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or whole or own.whole or conv != own.conv:
                    if own is not None:
                        rows.append(own.row())
                    own = _Digest(conv, whole)
                own.add(formatted, loss)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if own is not None:
            rows.append(own.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted rows hold: turns, masked text (both unescaped and digested) and code points."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = formatted.schema["conv_id"].dataType
    run, schema = _reading(to_arrow_type(field)), DIGEST.format(field.simpleString())
    columns = "conv_id", "whole", "formatted", "loss"
    split = formatted.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "range", "part")
    return formatted.where("whole").select(*columns).mapInArrow(run, schema).unionAll(split.select(*columns).mapInArrow(run, schema))


def round_trip(turns: DataFrame) -> DataFrame:
    """Format, write, and read back."""
    return read_back(written(format(turns), "formatted"))

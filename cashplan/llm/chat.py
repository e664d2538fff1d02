"""Chat formatting by schema fingerprints.

Records of any layout (a prompt and a response, an instruction with an input, a list of messages, one row per turn) are
JSON objects. The paths of a record's fields, hashed, are its fingerprint; the fingerprint selects a declarative mapping, and
the mapping says which fields are turns. So a layout is data, not code: to read a new one, list its fields.

Turns are written by a template that marks them. Control strings that occur inside texts are escaped, which reading back
undoes, so the marks are the only control strings of the output and every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashplan.llm.common import slices

PART_CHARS = 1 << 20


def field_paths(value, at: str = "") -> Iterator[str]:
    """The paths of all fields: ``a.b`` for nested ones, ``a[]`` for a list's elements. What a plain value is does not count."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from field_paths(inner, f"{at}.{_quoted(name)}" if at else _quoted(name))
    elif isinstance(value, list):
        yield f"{at}[]"
        for inner in value:
            if isinstance(inner, dict | list):
                yield from field_paths(inner, f"{at}[]")
    else:
        yield at


def _quoted(name: str) -> str:
    """A field's name, its dots and brackets told apart from those of paths."""
    return re.sub(r"([.\[\]\\])", r"\\\1", name)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Say:
    """One turn: the ``text`` field's, and those of the ``more`` fields that are not blank, below it. ``role`` is given, unless
    ``role_field`` names the field that holds it. With ``unless_blank`` a blank text makes no turn."""

    role: str | None
    text: str
    role_field: str | None = None
    more: tuple[str, ...] = ()
    unless_blank: bool = False

    def turns(self, record: dict, names: dict[str, str]) -> Iterator[tuple[str, str]]:
        texts = [_text(record.get(self.text)), *(_text(record.get(name)) for name in self.more)]
        if self.unless_blank and not texts[0].strip():
            return
        role = _text(record.get(self.role_field)) if self.role_field else self.role
        yield names.get(role, role), "\n\n".join([texts[0], *(x for x in texts[1:] if x.strip())])


@dataclass(frozen=True)
class Each:
    """A turn for each element of a list field."""

    items: str
    say: Say

    def turns(self, record: dict, names: dict[str, str]) -> Iterator[tuple[str, str]]:
        for item in record.get(self.items) or ():
            yield from self.say.turns(item if isinstance(item, dict) else {}, names)


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: the field paths that make up the layout, and the turns in them.

    ``optional`` paths may be there or not. ``place`` names the field by which records of one conversation are ordered.
    ``names`` maps the roles of this layout to canonical ones; others stay.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[Say | Each, ...]
    optional: tuple[str, ...] = ()
    place: str | None = None
    names: dict[str, str] = field(default_factory=dict)

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for some in combinations(self.optional, n):
                yield fingerprint(self.paths + some)


# Names that data sets give to roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_MESSAGE = Say(None, "content", role_field="role")
# The layouts known; records of an empty list have the path of the list alone.
LAYOUTS = (
    Layout("turn row", ("turn", "role", "text"), (Say(None, "text", role_field="role"),), place="turn"),
    Layout("prompt and response", ("prompt", "response"), (Say("system", "system", unless_blank=True), Say("user", "prompt"), Say("assistant", "response")), ("system",)),
    Layout("prompt and completion", ("prompt", "completion"), (Say("user", "prompt"), Say("assistant", "completion"))),
    Layout("question and answer", ("question", "answer"), (Say("user", "question"), Say("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (Say("user", "instruction", more=("input",)), Say("assistant", "output")), ("input",)),
    Layout("messages", ("messages[]",), (Each("messages", _MESSAGE),), ("messages[].role", "messages[].content")),
    Layout(
        "conversations",
        ("conversations[]",),
        (Each("conversations", Say(None, "value", role_field="from")),),
        ("conversations[].from", "conversations[].value"),
        names=ROLE_NAMES,
    ),
)


def _text(value) -> str:
    """A field's text: null is empty, what is not text is shown as JSON."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _by_fingerprint(layouts: Iterable[Layout]) -> dict[str, Layout]:
    found: dict[str, Layout] = {}
    for layout in layouts:
        for print_ in layout.fingerprints():
            if found.setdefault(print_, layout) is not layout:
                raise ValueError(f"{layout.name} and {found[print_].name} have the same fields")
    return found


def _read(text: str | None) -> tuple[dict | None, str]:
    """A record and its fingerprint; what is not a JSON object is None, with the fingerprint of no fields."""
    try:
        record = json.loads(text or "")
        if isinstance(record, dict):
            return record, fingerprint(field_paths(record))
    except (ValueError, RecursionError):  # no JSON, or nested too deeply to read
        pass
    return None, fingerprint(())


def records(rows: DataFrame, conv_id: str, *columns: str) -> DataFrame:
    """A table's rows as records, of the columns named: ``conv_id`` and ``record``."""
    struct = F.struct(*(F.col(name) for name in columns))
    return rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.to_json(struct, {"ignoreNullFields": "false"}).alias("record")
    )


def _canonical(layouts: tuple[Layout, ...]):
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _by_fingerprint(layouts)
        for batch in slices(batches):
            out = []
            for conv_id, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                record, print_ = _read(text)
                layout = known.get(print_)
                if layout is None or record is None:
                    continue
                place = record.get(layout.place) if layout.place else None
                place = place if type(place) is int and abs(place) < 1 << 63 else None
                of_record = (turn for say in layout.turns for turn in say.turns(record, layout.names))
                out.extend((conv_id, place, nth, role, said) for nth, (role, said) in enumerate(of_record))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)],
                ["conv_id", "place", "nth", "role", "text"],
            )

    return turns


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id``, ``place`` (by the layout's field, else null), ``nth`` (in the record), ``role`` and ``text`` of all turns.

    Reads ``conv_id`` and ``record`` (JSON) only. Null texts and roles are empty. Records of no known layout, null ones and such
    as are no JSON object have no turns; :func:`unmatched` counts them. No shuffle.
    """
    picked = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record"))
    return picked.mapInArrow(_canonical(layouts), "conv_id long, place long, nth long, role string, text string")


def unmatched(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The fingerprints that no layout has: ``fingerprint``, its ``paths``, the number of ``records``, and a ``conv_id`` of one."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _by_fingerprint(layouts)
        for batch in slices(batches):
            out = []
            for conv_id, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                record, print_ = _read(text)
                if record is None or print_ not in known:
                    out.append((conv_id, print_, sorted(set(field_paths(record))) if record is not None else None))
            columns = list(zip(*out, strict=True)) or [()] * 3
            types = (pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)],
                ["conv_id", "fingerprint", "paths"],
            )

    picked = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("record").cast("string").alias("record"))
    found = picked.mapInArrow(prints, "conv_id long, fingerprint string, paths array<string>")
    return found.groupBy("fingerprint").agg(
        F.min("paths").alias("paths"), F.count(F.lit(1)).alias("records"), F.min("conv_id").alias("conv_id")
    )


# What opens and closes a turn of each role; of any other role, the name stands between the first two.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER_MARKS = ("[ROLE]", "[/ROLE]", "[/TURN]")
LEARNT = "assistant"
#: Control strings, with any number of backslashes after their first sign. One more escapes them, one less undoes it.
CONTROL = r"([<\[])(\\*)(</?SYS>>|/?s>|/?(?:INST|ROLE|TURN)\])"
_CONTROL = re.compile(CONTROL)


def escaped(text: str) -> str:
    """The text with a backslash put into each control string, escaped ones too, so that it holds none."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and from where to where it is to be learnt (0, 0: not at all)."""
    safe = escaped(text)
    if role in MARKS:
        start, stop = MARKS[role]
        turn = f"{start}{safe}{stop}"
    else:
        name, start, stop = OTHER_MARKS
        turn = f"{name}{escaped(role)}{start}{safe}{stop}"
    return (turn, len(start), len(start) + len(safe)) if role == LEARNT else (turn, 0, 0)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The roles and texts of a formatted part, read by its marks."""
    opened = {start: role for role, (start, _) in MARKS.items()}
    at = 0
    while at < len(formatted):
        start = next((s for s in (*opened, OTHER_MARKS[0]) if formatted.startswith(s, at)), None)
        if start is None:
            raise ValueError(f"no turn starts at {at}: {formatted[at : at + 20]!r}")
        at += len(start)
        role = opened.get(start)
        if role is None:
            name_end = formatted.index(OTHER_MARKS[1], at)
            role, at, stop = unescaped(formatted[at:name_end]), name_end + len(OTHER_MARKS[1]), OTHER_MARKS[2]
        else:
            stop = MARKS[role][1]
        end = formatted.index(stop.strip(), at) - (len(stop) - len(stop.lstrip()))
        yield role, unescaped(formatted[at:end])
        at = end + len(stop)


_PARTS = "conv_id long, part int, formatted string, loss array<struct<start:long,stop:long>>"


def _marker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        done = [
            marked(role or "", text or "")
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
        ]
        turn, start, stop = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(name) for name in ("conv_id", "place", "nth")),
                pa.array(turn, pa.string()),
                pa.array(start, pa.int64()),
                pa.array(stop, pa.int64()),
                batch.column("role"),
            ],
            ["conv_id", "place", "nth", "turn", "start", "stop", "role"],
        )


def _assembler(part_chars: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        conv, part, text, loss = zip(*rows, strict=True)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(conv, pa.int64()),
                pa.array(part, pa.int32()),
                pa.array(text, pa.string()),
                pa.array([[{"start": a, "stop": b} for a, b in x] for x in loss], spans),
            ],
            ["conv_id", "part", "formatted", "loss"],
        )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv_id, part, turns, loss, chars = False, None, 0, [], [], 0
        for batch in slices(batches):
            done = []
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn", "start", "stop", "role"))
            for conv, turn, start, stop, role in zip(*columns, strict=True):
                new = not open_ or conv != conv_id
                if open_ and (new or chars + len(turn) > part_chars):
                    done.append((conv_id, part, "".join(turns), loss))
                    part, turns, loss, chars = 0 if new else part + 1, [], [], 0
                open_, conv_id = True, conv
                if role == LEARNT:
                    loss.append((chars + start, chars + stop))
                turns.append(turn)
                chars += len(turn)
            if done:
                yield batch_of(done)
        if open_:
            yield batch_of([(conv_id, part, "".join(turns), loss)])

    return assemble


def formatted(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations as training text: ``conv_id``, ``part``, ``formatted`` and ``loss``, the spans (code points) to learn.

    ``turns`` are those of :func:`canonical_turns`. A conversation's turns stand by ``place`` (nulls first), then ``nth``; ties go by
    role and text, and repeated rows stay each. Turns of a null ``conv_id`` are one conversation. Up to ``part_chars``
    characters a conversation is one part; a longer one goes on in further parts, each of whole turns, none left out. An
    empty table gives an empty one.

    Each turn is written where its record is read. One shuffle brings a conversation's turns together, sorted, and a task
    streams through them, so it holds a part and never a conversation, however many turns one has.
    """
    schema = "conv_id long, place long, nth long, turn string, start long, stop long, role string"
    pieces = turns.select("conv_id", "place", "nth", "role", "text").mapInArrow(_marker, schema)
    in_turn = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth", "role", "turn")
    return in_turn.mapInArrow(_assembler(part_chars), _PARTS)


def in_sequence(parts: DataFrame) -> DataFrame:
    """Parts that were stored, in an order that :func:`read_back` can read."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    class Conversation:
        def __init__(self, conv_id):
            self.conv_id, self.n, self.chars, self.learnt = conv_id, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, spans: list[dict]) -> None:
            for role, said in turns_of(text):
                self.n += 1
                self.turns.update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescaped(text[span["start"] : span["stop"]])
                self.learnt += len(said)
                self.loss.update(said.encode())
            self.chars += len(text)

        def row(self) -> tuple:
            return self.conv_id, self.n, self.turns.hexdigest(), self.learnt, self.loss.hexdigest(), self.chars

    def batch_of(done: list[Conversation]) -> pa.RecordBatch:
        columns = zip(*(x.row() for x in done), strict=True)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    present: Conversation | None = None
    for batch in slices(batches):
        done = []
        columns = (batch.column(name).to_pylist() for name in ("conv_id", "formatted", "loss"))
        for conv_id, text, spans in zip(*columns, strict=True):
            if present is None or present.conv_id != conv_id:
                if present is not None:
                    done.append(present)
                present = Conversation(conv_id)
            present.add(text or "", spans or [])
        if done:
            yield batch_of(done)
    if present is not None:
        yield batch_of([present])


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted parts alone: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256`` and ``formatted_chars``.

    The parts must come as :func:`formatted` lays them out; those read from a table go through :func:`in_sequence` first.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.mapInArrow(_reader, schema)


def table_records(conversations: DataFrame) -> DataFrame:
    """The rows of a table of turns as records; columns other than ``conv_id``, ``turn``, ``role`` and ``text`` stay out."""

    def text(name: str) -> Column:
        return F.col(name).cast("string").alias(name)

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return records(rows, "conv_id", "turn", "role", "text")

"""Chat formatting by schema fingerprints.

A record is a JSON object of any layout: a prompt with its completion, an instruction with input and output, a list of messages, a
single turn.  The paths of its nested fields are hashed; a fingerprint is looked up among those met before, and one that is new is held
against the declared layouts once.  A layout says where roles and texts stand, so that every record becomes turns (role, text).

Turns are written in a :class:`Template`: marks around role and text, an escape for everything in them that looks like a mark, and a
loss mask.  :func:`read_back` parses the written text alone and gives the turns and what the mask covers.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list at ``items`` ('' is the record itself): its role and its text, by path from the element."""

    items: str
    role: str
    text: str
    aliases: tuple[tuple[str, str], ...] = ()

    def needs(self) -> tuple[str, ...]:
        return tuple(f"{self.items}[].{p}" for p in (self.role, self.text))

    def turns(self, record) -> list[tuple[str, str]]:
        names = dict(self.aliases)
        return [(names.get(role, role), _text(_at(x, self.text))) for x in _listed(_at(record, self.items)) for role in [_text(_at(x, self.role))]]


@dataclass(frozen=True)
class One:
    """One turn of a fixed role, or of the role at the path ``role_at``; its text is what stands at the paths, parted by a blank line where several
    are not empty.  An ``optional`` one is left out where its text is empty."""

    role: str
    text: tuple[str, ...]
    optional: bool = False
    role_at: str = ""

    def needs(self) -> tuple[str, ...]:
        return () if self.optional else (*self.text[:1], *([self.role_at] if self.role_at else []))

    def turns(self, record) -> list[tuple[str, str]]:
        text = "\n\n".join(t for t in (_text(_at(record, p)) for p in self.text) if t)
        role = _text(_at(record, self.role_at)) if self.role_at else self.role
        return [] if self.optional and not text else [(role, text)]


@dataclass(frozen=True)
class Layout:
    name: str
    parts: tuple[Each | One, ...]

    def fits(self, paths: frozenset[str]) -> bool:
        """All fields that the layout needs are there; an empty list has all fields of its elements."""
        return all(p in paths or any(p[:i] in paths for i in (m.end() for m in re.finditer(r"\[\]", p))) for part in self.parts for p in part.needs())


_SPOKEN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: the first that fits is taken; other fields of a record don't matter
LAYOUTS = (
    Layout("message_parts", (Each("messages", "role", "content[].text"),)),
    Layout("messages", (Each("messages", "role", "content"),)),
    Layout("message_list", (Each("", "role", "content"),)),
    Layout("from_value", (One("system", ("system",), optional=True), Each("conversations", "from", "value", _SPOKEN))),
    Layout("speaker_text", (Each("dialog", "speaker", "text", _SPOKEN),)),
    Layout("turn", (One("", ("text",), role_at="role"),)),
    Layout("instruction", (One("system", ("system",), optional=True), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Layout("instruction_response", (One("user", ("instruction", "context")), One("assistant", ("response",)))),
    Layout("prompt_completion", (One("system", ("system",), optional=True), One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("prompt_response", (One("system", ("system",), optional=True), One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("question_answer", (One("user", ("context", "question")), One("assistant", ("answer",)))),
)


def _key(k: str) -> str:
    return re.sub(r"([\\.\[\]])", r"\\\1", k)


def paths(value, at: str = "") -> set[str]:
    """The paths of all leaves: keys with dots between, ``[]`` for the elements of a list.  Nulls and empty objects are leaves, an empty
    list is one by the path of its elements."""
    found, waiting = set(), [(value, at)]
    while waiting:
        v, p = waiting.pop()
        if isinstance(v, dict) and v:
            waiting += [(x, f"{p}.{_key(k)}" if p else _key(k)) for k, x in v.items()]
        elif isinstance(v, list):
            waiting += [(x, f"{p}[]") for x in v]
            if not v:
                found.add(f"{p}[]")
        else:
            found.add(p)
    return found


def _steps(path: str) -> list[str]:
    return [re.sub(r"\\(.)", r"\1", s) for s in re.findall(r"(?:\\.|[^.\\])+", path)]


def _at(value, path: str):
    """What stands at a path; a list where the path goes through one."""
    for n, step in enumerate(steps := _steps(path)):
        if step.endswith("[]"):
            rest = ".".join(_key(s) if not s.endswith("[]") else s for s in steps[n + 1 :])
            return [_at(x, rest) for x in _listed(value.get(step[:-2]) if isinstance(value, dict) else None)]
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _listed(value) -> list:
    return value if isinstance(value, list) else []


def _text(value) -> str:
    """A string as it is, nothing for null, the parts of a list in one, JSON of anything else."""
    if isinstance(value, list) and all(isinstance(v, str) or v is None for v in value):
        return "".join(v or "" for v in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def fingerprint(of: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


#: fingerprints that a worker remembers
KNOWN = 10_000


class Reader:
    """Turns of records, by their fingerprints."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.known = layouts, {}

    def layout(self, of: set[str]) -> tuple[str, Layout | None]:
        mark = fingerprint(of)
        if mark not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[mark] = next((x for x in self.layouts if x.fits(frozenset(of))), None)
        return mark, self.known[mark]

    def read(self, record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        """(fingerprint, name of the layout, turns); no layout where none fits, and no fingerprint where it is no JSON."""
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            return None, None, []
        if value is None:
            return None, None, []
        mark, layout = self.layout(paths(value))
        return (mark, None, []) if layout is None else (mark, layout.name, [t for part in layout.parts for t in part.turns(value)])


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """From (key, record: JSON) to (key, place, role, text, layout, fingerprint), a row for each turn with its place in the record.

    A record without turns gives one row whose place, role and text are null; its layout is null, too, where none fits, and so is its
    fingerprint where it is null or no JSON.  Nothing is left out."""
    key = records.schema["key"].dataType

    def run(batches):
        reader = Reader(layouts)
        for batch in batches:
            out, rows = [], []
            for i, record in enumerate(batch.column("record").to_pylist()):
                mark, name, turns = reader.read(record)
                for place, (role, text) in enumerate(turns) if turns else [(None, (None, None))]:
                    rows.append(i)
                    out.append((place, role, text, name, mark))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", "place", "role", "text", "layout", "fingerprint"])

    return records.select("key", "record").mapInArrow(run, f"key {key.simpleString()}, place long, role string, text string, layout string, fingerprint string")


@dataclass(frozen=True)
class Template:
    """Marks before the role, after it and after the text; ``control`` are further strings that must not stand in a text as they are."""

    before_role: str = "### "
    after_role: str = ": "
    after_text: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("</turn>", "<|endoftext|>")

    def __post_init__(self):
        for c in (self.before_role, self.after_role, self.after_text, *self.control):
            if len(c) < 2 or ESCAPE in c:
                raise ValueError(f"a control string has two characters at least, and no {ESCAPE}: {c!r}")
        for c in (self.after_role, self.after_text):  # else a text's end and the mark might look like the mark, one place too early
            if any(c.endswith(c[:k]) for k in range(1, len(c))):
                raise ValueError(f"a closing mark must not end as it begins: {c!r}")

    def escaped(self, text: Column, role: bool = False) -> Column:
        """``text`` with its backslashes doubled, and one behind the first character of each control string: none is left, overlapping ones
        neither."""
        marks = {self.before_role, self.after_text, *self.control, *([self.after_role] if role else [])}
        broken = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in sorted(marks))
        return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), broken, r"$0\\")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(turns: DataFrame, order: list[str], template: Template = Template()) -> DataFrame:
    """The turns (conversation, role, text and the columns of ``order``, which goes nulls first) as written: (conversation, n, piece, start,
    loss_start, loss_stop), a piece for each turn.

    The pieces of a conversation, in order of n, are its text; ``start`` is where a piece begins in it, and the loss mask covers the
    characters from loss_start to before loss_stop (null where it covers none).  Null roles and texts are empty; turns that ``order``
    leaves equal go by role and text, so that only equal turns are interchangeable.  A conversation may have any number of turns: they are
    sorted, spilling if need be, and pass by."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    made = turns.select("conversation", *order, role.alias("role"), text.alias("text")).select(
        "conversation", *order, "role", "text", F.concat(F.lit(template.before_role), template.escaped(F.col("role"), role=True), F.lit(template.after_role)).alias("head"), template.escaped(F.col("text")).alias("body")
    )
    made = made.withColumn("piece", F.concat("head", "body", F.lit(template.after_text)))
    by = Window.partitionBy("conversation").orderBy(*(F.col(c).asc_nulls_first() for c in (*order, "role", "text")))
    made = made.select("*", F.row_number().over(by).cast("long").alias("n"), (F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")).alias("start"))
    loss = F.when(F.col("role").isin(*template.trained), F.col("start") + F.length("head"))
    return made.select("conversation", "n", "piece", "start", loss.alias("loss_start"), (loss + F.length("body")).alias("loss_stop"))


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Read:
    """Reads a conversation's text as it comes in; holds no more than the turn that it is in."""

    def __init__(self, template: Template):
        self.t, self.held, self.at, self.spans = template, "", 0, []
        self.turns, self.loss, self.n, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0

    def put(self, piece: str, start: int | None, stop: int | None) -> None:
        self.held += piece
        if start is not None:
            self.spans.append((start, stop))
        t = self.t
        while self.held.startswith(t.before_role):
            colon = self.held.find(t.after_role, len(t.before_role))
            end = self.held.find(t.after_text, colon + len(t.after_role)) if colon >= 0 else -1
            if end < 0:
                return
            role, text = unescaped(self.held[len(t.before_role) : colon]), unescaped(self.held[colon + len(t.after_role) : end])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
            whole = end + len(t.after_text)
            while self.spans and self.spans[0][1] <= self.at + whole:
                a, b = self.spans.pop(0)
                learned = unescaped(self.held[a - self.at : b - self.at])
                self.chars += len(learned)
                self.loss.update(learned.encode())
            self.held, self.at = self.held[whole:], self.at + whole

    def end(self) -> tuple:
        if self.held or self.spans:
            raise ValueError("a formatted text ends within a turn")
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.at


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """What is read from the text of :func:`formatted`: (conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    turns_sha256 is of role, newline, text, newline for each turn; the loss columns are of the unescaped text under the mask.  Digests are
    of whole conversations, so one conversation passes through one task, turn by turn."""
    kind = pieces.schema["conversation"].dataType.simpleString()
    ready = pieces.repartition("conversation").sortWithinPartitions("conversation", "n").select("conversation", "piece", "loss_start", "loss_stop")

    def run(batches):
        at, now = None, None
        columns = ["conversation", *(c.split()[0] for c in READ_BACK.split(", "))]
        for batch in batches:
            done = []
            for c, piece, start, stop in zip(*(batch.column(k).to_pylist() for k in ("conversation", "piece", "loss_start", "loss_stop"))):
                if now is None or c != at:
                    if now is not None:
                        done.append((at, *now.end()))
                    at, now = c, _Read(template)
                now.put(piece, start, stop)
            yield _batch(done, columns, batch.schema.field("conversation").type)
            kept = batch.schema.field("conversation").type
        if now is not None:
            yield _batch([(at, *now.end())], columns, kept)

    def _batch(rows, columns, key):
        kinds = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [()] * 6, kinds)], columns)

    return ready.mapInArrow(run, f"conversation {kind}, {READ_BACK}")

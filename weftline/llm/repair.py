"""Repair of conversation structure by signatures.

What a repair hangs on is the sequence of roles and faults of a conversation's rows, one character a row: the signature.  Each different
signature is solved once, by recursion over its halves with a memo, for the cheapest edits that give the roles ``(s?(ua)+)?``; the edits
(the audit) are joined back to the conversations and replayed over their rows.

Edits: K keeps a row, R gives it the role that is due, D deletes it, I puts in a row without text of the role that is due.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import dealt_join, one_key, released, written

#: fixed values: what edits cost; a truncated row that stays costs TRUNCATED more
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: what has been read: nothing, a system row, a row of the user, one of the assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state and the role that follow an inserted or renamed row
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: the state after a kept row, by its role's initial
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: a row that has to go; other rows are s, u, a or x (another role), in capitals if they are truncated
GONE = "-"
#: may the conversation end here?
ENDS = (0, None, None, 0)
#: fixed value: white space
SPACE = "\\x20\\x09-\\x0D"


def _plus(*costs):
    return None if None in costs else sum(costs)


def _least(costs):
    return min((c for c in costs if c is not None), default=None)


def options(state: int, row: str) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, but for rows put in before it."""
    yield "D", DELETE, state
    if row == GONE:
        return
    more = TRUNCATED if row.isupper() else 0
    if (state, row.lower()) in KEPT:
        yield "K", KEEP + more, KEPT[state, row.lower()]
    yield "R", REROLE + more, DUE[state]


class Solver:
    """Cheapest audits.  Costs of a part of a signature, from each state to each, are kept by its text: parts that come back are worked out once,
    and the recursion is no deeper than the logarithm of the length."""

    #: parts of up to so many rows are kept, so many at most
    LONGEST, ROOM = 64, 100_000

    def __init__(self):
        self.memo: dict[str, list[list[int | None]]] = {}

    def costs(self, part: str) -> list[list[int | None]]:
        """The least cost of the part from each state to each; rows may be put in before each of its rows, none behind the last."""
        found = self.memo.get(part)
        if found is None:
            found = self._row(part) if len(part) == 1 else self._both(self.costs(part[: len(part) // 2]), self.costs(part[len(part) // 2 :]))
            if len(part) <= self.LONGEST:
                if len(self.memo) >= self.ROOM:
                    self.memo.clear()
                self.memo[part] = found
        return found

    @staticmethod
    def _both(left, right):
        return [[_least(_plus(left[a][m], right[m][b]) for m in range(4)) for b in range(4)] for a in range(4)]

    @staticmethod
    def _row(row: str):
        plain = [[_least(c for _, c, to in options(a, row) if to == b) for b in range(4)] for a in range(4)]
        once = [[_least((plain[a][b], _plus(INSERT, plain[DUE[a]][b]))) for b in range(4)] for a in range(4)]
        return [[_least((plain[a][b], _plus(INSERT, once[DUE[a]][b]))) for b in range(4)] for a in range(4)]

    @staticmethod
    def _before(costs, after):
        """The least cost from each state through a part to the end, given that from each state behind it."""
        return [_least(_plus(costs[a][b], after[b]) for b in range(4)) for a in range(4)]

    @staticmethod
    def _inserted(after):
        """With rows put in where that is cheaper: two at most, for a third would be a state that was there already."""
        for _ in range(2):
            after = [_least((after[a], _plus(INSERT, after[DUE[a]]))) for a in range(4)]
        return after

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit); of equal costs the audit that comes first in ASCII order.  In a state no two edits have the same letter, so the first letter
        that keeps to the least cost is the right one each time."""
        end = self._inserted(list(ENDS))
        total = self._before(self.costs(signature), end)[START] if signature else end[START]
        audit: list[str] = []
        state = self._trace(signature, START, end, audit) if signature else START
        while ENDS[state] is None:
            audit.append("I")
            state = DUE[state]
        return total, "".join(audit)

    def _trace(self, part: str, state: int, after, audit: list[str]) -> int:
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            return self._trace(right, self._trace(left, state, self._before(self.costs(right), after), audit), after, audit)
        here = self._before(self._row(part), after)
        while True:
            rest = sorted([(e, c, after[to], to) for e, c, to in options(state, part)] + [("I", INSERT, here[DUE[state]], None)])
            edit, to = next((e, to) for e, c, more, to in rest if more is not None and c + more == here[state])
            audit.append(edit)
            if edit != "I":
                return to
            state = DUE[state]


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) for (signature)."""

    def run(batches):
        solver = Solver()
        for batch in batches:
            found = [solver.solve(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    return signatures.select("signature").mapInArrow(released(run), "signature string, cost long, audit string")


def _ordered(rows: DataFrame, gone: Column, more: tuple = ()) -> tuple[DataFrame, list[Column]]:
    """The rows with ``__k`` (the conversation), ``__gone`` and ``__h`` (a digest of role and text), dealt by conversation, and their order."""
    digest = F.unhex(F.md5(F.concat(F.md5(F.col("role").cast("binary")), F.col("text")).cast("binary")))
    dealt = rows.select(one_key(F.col("conversation")).alias("__k"), "conversation", "turn", "role", gone.alias("__gone"), digest.alias("__h"), *more).repartition("__k")
    return dealt, [F.col("__gone").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("__h").asc()]


#: of a conversation, besides its signature
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """(__k, conversation, signature and ``COUNTS``) of rows (conversation, turn, role, text; roles and texts not null).

    Rows go by turn (nulls first), then role and a digest of both role and text.  A conversation all of whose rows are ``gone`` has an empty
    signature; such rows count for nothing else.  Texts are not moved: a digest stands for them."""
    some = f"[^{SPACE}]"
    last = F.regexp_extract("text", f"({some})[{SPACE}]*\\z", 1)
    marks = (F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("").alias("__mark"),)
    dealt, order = _ordered(rows, F.lit(False) if gone is None else gone, marks)
    first = Window.partitionBy("__k", "__gone", "role", "__h").orderBy(F.col("turn").asc_nulls_first())
    place = Window.partitionBy("__k").orderBy(*order)
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    seen = dealt.withColumn("__mark", F.when(F.col("__mark") == "b", "b").when(F.row_number().over(first) > 1, "d").otherwise(F.col("__mark")))
    seen = seen.select(
        "__k", "conversation", "turn", "__gone", "__mark", F.when(F.col("__mark").isin("b", "d"), GONE).when(F.col("__mark") == "t", F.upper(known)).otherwise(known).alias("code"), F.row_number().over(place).alias("__n"),
        ((F.row_number().over(place) > 1) & ~F.concat(F.lag(known).over(place), known).isin("su", "ua", "au")).alias("illegal"),
    )

    def run(batches):
        at, now, kept = None, None, None
        for batch in batches:
            out = []
            names = ("__k", "turn", "__gone", "__mark", "code", "illegal")
            ids = batch.column("conversation")
            for i, (k, turn, gone_, mark, code, illegal) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if k != at or now is None:
                    if now is not None:
                        out.append(now.row())
                    at, now = k, _Signature(k, ids[i].as_py())
                if not gone_:
                    now.put(turn, mark, code, illegal)
            kept = ids.type
            yield _rows(out, kept)
        if now is not None:
            yield _rows([now.row()], kept)

    def _rows(out, kind):
        kinds = (pa.string(), kind, pa.string(), *[pa.int64()] * len(COUNTS))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) if out else [()] * len(kinds), kinds)], ["__k", "conversation", "signature", *COUNTS])

    ready = seen.sortWithinPartitions("__k", "__n").select("__k", "conversation", "turn", "__gone", "__mark", "code", "illegal")
    kind = rows.schema["conversation"].dataType.simpleString()
    return ready.mapInArrow(run, f"__k string, conversation {kind}, signature string, {', '.join(f'{c} long' for c in COUNTS)}")


class _Signature:
    """A conversation's signature as its rows pass by, in order of their turns."""

    def __init__(self, key, conversation):
        self.key, self.conversation, self.codes = key, conversation, []
        self.low = self.high = None
        self.turns, self.marks, self.illegal = 0, {"b": 0, "d": 0, "t": 0, "": 0}, 0

    def put(self, turn, mark, code, illegal):
        self.codes.append(code)
        self.marks[mark] += 1
        self.illegal += illegal
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.key, self.conversation, "".join(self.codes), gaps, self.marks["b"], self.marks["d"], self.marks["t"], self.illegal


def audits(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """(__k, conversation, ``COUNTS``, cost, audit): each different signature is solved once and joined back; common ones are no task of their own."""
    signed = written(signatures(rows, gone), "signatures")
    kinds = written(signed.groupBy("signature").agg(F.count(F.lit(1)).alias("__rows")), "kinds")
    known = written(solved(kinds).join(kinds, "signature"), "solved")
    return dealt_join(signed, known, ["signature"], "__rows").select("__k", "conversation", *COUNTS, "cost", "audit")


def replayed(rows: DataFrame, found: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired rows: (conversation, place, role, text, edit, told), those of a conversation one after the other.  ``told`` are the figures
    of ``found`` (:func:`audits`), with the first row of a conversation; one without rows has a single row, whose place, role and text are null.

    An audit goes with the first row of its conversation, so that long ones are not moved with each row."""
    dealt, order = _ordered(rows, F.lit(False) if gone is None else gone, ("text",))
    placed = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*order)))
    told = found.select(F.col("__k").alias("__o"), F.struct(*COUNTS, "cost", "audit").alias("told"))
    ready = placed.join(told, (F.col("__k") == F.col("__o")) & (F.col("__n") == 1), "left").sortWithinPartitions("__k", "__n").select("conversation", "role", "text", "__gone", "__n", "told")

    def run(batches):
        now, kinds = None, None
        for batch in batches:
            kinds = (batch.schema.field("conversation").type, pa.int64(), pa.string(), pa.string(), pa.string(), batch.schema.field("told").type)
            out = []
            tells = batch.column("told")
            for i, (c, role, text, gone_, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("conversation", "role", "text", "__gone", "__n")))):
                if n == 1:
                    if now is not None:
                        out += now.end()
                    now = _Replay(c, tells[i].as_py())
                if not gone_:
                    out += now.put(role, text)
            yield _batch(out, kinds)
        if now is not None:
            yield _batch(now.end(), kinds)

    def _batch(out, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) if out else [()] * 6, kinds)], ["conversation", "place", "role", "text", "edit", "told"])

    kind, tells = rows.schema["conversation"].dataType.simpleString(), ready.schema["told"].dataType.simpleString()
    return ready.mapInArrow(run, f"conversation {kind}, place long, role string, text string, edit string, told {tells}")


class _Replay:
    def __init__(self, conversation, told):
        self.conversation, self.told, self.audit = conversation, told, iter(told["audit"])
        self.state, self.place = START, 0

    def _row(self, role, text, edit):
        row = self.conversation, self.place, role, text, edit, self.told if self.place == 0 else None
        self.place += 1
        return row

    def _put_in(self):
        self.state = DUE[self.state]
        return self._row(ROLES[self.state], "", "I")

    def put(self, role, text):
        for edit in self.audit:
            if edit == "I":
                yield self._put_in()
                continue
            if edit != "D":
                self.state = KEPT[self.state, role[:1]] if edit == "K" else DUE[self.state]
                yield self._row(role if edit == "K" else ROLES[self.state], text, edit)
            return

    def end(self):
        rows = [self._put_in() for _ in self.audit]
        return rows if self.place else [(self.conversation, None, None, None, None, self.told)]


def digests(repaired: DataFrame) -> DataFrame:
    """(conversation, the figures of its audit, repaired_sha256 of ``role:text`` of its rows with a newline between) of :func:`replayed` rows as they
    come.  A digest is of the whole conversation, whose rows pass through one task."""
    told, kind = repaired.schema["told"].dataType, repaired.schema["conversation"].dataType.simpleString()

    def run(batches):
        now, kinds = None, None
        for batch in batches:
            kinds = (batch.schema.field("conversation").type, batch.schema.field("told").type, pa.string())
            out, tells = [], batch.column("told")
            for i, (c, place, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("conversation", "place", "role", "text")))):
                if tells[i].is_valid:
                    if now is not None:
                        out.append((*now[:2], now[2].hexdigest()))
                    now = c, tells[i].as_py(), hashlib.sha256()
                if place is not None:
                    now[2].update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield _batch(out, kinds)
        if now is not None:
            yield _batch([(*now[:2], now[2].hexdigest())], kinds)

    def _batch(out, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) if out else [()] * 3, kinds)], ["conversation", "told", "repaired_sha256"])

    return repaired.mapInArrow(run, f"conversation {kind}, told {told.simpleString()}, repaired_sha256 string").select("conversation", "told.*", "repaired_sha256")


def repaired(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The rows of :func:`replayed` for conversations (conversation, turn, role, text); null roles and texts are one space.  Texts that are blank
    or come twice with the same role go; rows marked ``gone`` do not count, but their conversation does."""
    whole = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    return replayed(whole, written(audits(whole, gone), "audits"), gone)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conversation, turn, role, text) with faults by crc32 of ``conversation:turn`` modulo 20 (nulls are one space, also in that text): 0 marks
    the row ``gone``, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 gives it to the user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conversation").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    made = rows.select("conversation", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"), kind.alias("__kind"))
    return made.withColumn("__copy", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__kind", "__copy")

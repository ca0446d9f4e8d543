import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from weftline.llm import repair

SPACE = " \t\n\x0b\x0c\r"


@lru_cache(None)
def plain(rows, state):
    """(cost, audit) of rows (initial, has to go, truncated) from a state, by trying every edit with up to two rows put in before it."""
    best, to = [], state
    for n in range(3):
        due = "a" if to == "u" else "u"
        steps = [("D", 4, to)] if rows else []
        if rows and not rows[0][1]:
            steps.append(("R", 3 + 3 * rows[0][2], due))
            if rows[0][0] == due or rows[0][0] == "s" and to == "":
                steps.append(("K", 3 * rows[0][2], rows[0][0]))
        for edit, price, following in steps:
            cost, audit = plain(rows[1:], following)
            best.append((3 * n + price + cost, "I" * n + edit + audit))
        if not rows and to in ("", "a"):
            best.append((3 * n, "I" * n))
        to = due
    return min(best)


def brute(rows):
    """conv_id -> the contract's row."""
    out = {}
    for c in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(hashlib.md5(r[1].encode()).hexdigest().encode() + r[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in after:
            solid = text.rstrip(SPACE)
            marks.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in after]
        turns = [t for t, _, _ in after if t is not None]
        cost, audit = plain(tuple((i, m in ("blank", "duplicate"), m == "truncated") for i, m in zip(initials, marks)), "")
        lines, left, last = [], list(after), ""
        for e in audit:
            row = left.pop(0) if e != "I" else (None, "", "")
            if e != "D":
                due = "assistant" if last == "u" else "user"
                role = row[1] if e == "K" else due
                lines.append(f"{role}:{row[2]}")
                last = role[:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and not left
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    got = [(r.conversation, (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def repaired(df):
    from pyspark.sql import functions as F

    return repair.digests(repair.repaired(repair.damaged(df), F.col("gone")))


SCHEMA = "conversation long, turn long, role string, text string"


def test_every_short_signature():
    solver = repair.Solver()
    for n in range(5):
        for s in product("suaxSUAX-", repeat=n):
            rows = tuple((c.lower(), c == "-", c.isupper()) for c in s)
            assert solver.solve("".join(s)) == plain(rows, ""), s


def test_long_signature():
    rng = random.Random(3)
    s = "".join(rng.choice("suaxSUAX-") for _ in range(300))
    solver = repair.Solver()
    cost, audit = solver.solve(s)
    assert audit.translate({ord("I"): None}).__len__() == 300
    assert (cost, audit) == plain(tuple((c.lower(), c == "-", c.isupper()) for c in s), "")
    cost, audit = solver.solve("ua" * 50_000)  # no deeper than the logarithm, most parts from the memo
    assert cost == 0 and audit == "K" * 100_000


def test_against_brute_force(make):
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "u", "Sys"], ["Yes.", "No!", "Why?", "cut", " ", None, "", "Done. \n", "x ", "é."]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(texts)) for c in [None, *range(150)] for _ in range(rng.randrange(1, 12))]
    assert result(repaired(make(rows, SCHEMA))) == brute(rows)


def test_whole_tables(spark, sf):
    from weftline.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(registry.op12_conversation_repair(spark, sf).withColumnRenamed("conv_id", "conversation")) == brute(rows)


def test_repaired_rows(make):
    got = repair.repaired(make([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?"), (2, 0, None, None)], SCHEMA)).collect()
    assert [(r.conversation, r.place, r.role, r.text, r.edit) for r in sorted(got, key=lambda r: (r.conversation, r.place or 0))] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "So?", "R"), (2, None, None, None, None)]


def test_common_signatures_and_odd_tables(make, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}.") for c in range(300) for t in range(2)] + [(1000 + c, 0, "system", "cut") for c in range(3)]
    want = brute(rows)
    assert result(repaired(make(rows, SCHEMA))) == want
    monkeypatch.setattr("weftline.llm.common.HEAVY", 0)  # all by shuffle
    assert result(repaired(make(rows, SCHEMA))) == want
    assert result(repaired(make([], SCHEMA))) == {}


@pytest.mark.parametrize("n", [3, 50])
def test_partitions_do_not_matter(make, n):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(("user", "assistant")), rng.choice(("A.", "b"))) for c in range(40) for t in range(rng.randrange(1, 30))]
    assert result(repaired(make(rows, SCHEMA).repartition(n))) == brute(rows)

"""Names of which one half clashes: no line and no document is lost to another set or text."""

import random

from helpers import prose
from weftline.llm import lines, shingles


def test_no_document_is_taken_for_another(make):
    """Three bits of the first half: nearly all sets clash, and groups are still of equal or similar texts only."""
    rng = random.Random(1)
    texts = [prose(rng, 40) for _ in range(60)]
    docs = [(i, texts[i % 60]) for i in range(120)] + [(500 + i, None if i else "") for i in range(3)]
    whole = {r.row: r.group for r in shingles.groups(make(docs), "doc_id").collect()}
    few = {r.row: r.group for r in shingles.groups(make(docs), "doc_id", half=3).collect()}
    together = lambda g: {frozenset(k for k in g if g[k] == v) for v in g.values()}
    assert together(whole) == together(few) == {frozenset((i, i + 60)) for i in range(60)} | {frozenset((500, 501, 502))}


def test_no_line_is_lost_to_another(make):
    """With clashing names only lines go that are like an earlier one; in both forms, and texts with a name of their own lose what they did."""
    rng = random.Random(2)
    own = [prose(rng, 12) for _ in range(200)]
    docs = [(i, "\n".join([own[i], own[(i * 7) % 100], f"{own[i + 100]}"])) for i in range(100)]
    for copies in (False, True):
        for half in (64, 6):
            got = {r.doc_id: r.text for r in lines.dedup(make(docs), floor=1, copies=copies, half=half).collect()}
            left = {x for t in got.values() for x in t.split("\n")}
            assert left >= set(own)  # of each line one is left somewhere
            if half == 64 and not copies:
                assert sum(len(t.split("\n")) for t in got.values()) == len(left)

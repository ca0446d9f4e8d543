import random

import pytest
from helpers import prose
from pyspark.sql import functions as F
from weftline.llm import lines, linesets


def corpus(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 30)) for _ in range(20)]
    rows = []
    for d in range(50):
        ls = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = prose(rng, 1)
            ls.append(" ".join(w))
        rows.append((d if d % 7 else None, "\n".join(ls)))
    return rows + rows[:9]


def brute(rows, seed_tie):
    """Rows in order of (id, hash of the text), nulls first; each line against all before it."""
    before, out = [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, seed_tie[r[1]])):
        kept, gone = [], 0
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            like = bool(words) and any(len(words & b) * 5 >= len(words | b) * 4 for b in before)
            before += [words] if words else []
            gone += like
            kept += [] if like else [line]
        out.append((doc, "\n".join(kept), gone))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 211])
def test_result_does_not_hang_on_partitions(make, parts, monkeypatch):
    rows = corpus()
    tie = {r.text: r.h for r in make(rows).select("text", F.xxhash64("text").alias("h")).collect()}
    random.Random(parts).shuffle(rows)
    if parts == 3:
        monkeypatch.setattr(lines, "LEADERS", 2)
        monkeypatch.setattr(lines, "COMMON", 2)
    got = lines.dedup(make(rows).repartition(parts), floor=1).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=str) == brute(rows, tie)


def test_columns_of_any_name_keep_their_values(make):
    rows = [(1, "one two three four five six", 7, 8, 9, 10), (2, "one two three four five six\nother", 11, 12, 13, 14)]
    docs = make(rows, "doc_id long, text string, num long, key long, z int, n_lines int")
    got = {r.doc_id: r for r in lines.dedup(docs, floor=1, counts=("__lines", "__gone")).collect()}
    assert [(got[k].num, got[k]["key"], got[k].z, got[k].n_lines, got[k]["__gone"]) for k in (1, 2)] == [(7, 8, 9, 10, 0), (11, 12, 13, 14, 1)]
    assert got[2].text == "other"


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(linesets, "SLICE_BYTES", 64)
    rng = random.Random(1)
    texts = ["\n".join(" ".join(rng.choice(["a", "Bb", "longerthaneightbytes", "été", "x1"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40))).encode() for _ in range(40)] + [b"", None, b"\n", b"  ", b"end \n"]
    got = {(int(s.text[k]), int(s.line[k])): (int(i), int(s.n[k])) for s in linesets.sets_of(texts) for k, i in enumerate(s.ids()[0])}
    want = {(i, k): frozenset(x.lower().split()) for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.split(b"\n")) if x.split()}
    names = {}
    assert set(got) == set(want)
    assert all(names.setdefault(want[k], got[k][0]) == got[k][0] and got[k][1] == len(want[k]) for k in want)
    assert len(set(names.values())) == len(names)

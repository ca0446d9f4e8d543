import random

from helpers import prose
from weftline.llm import lines


def brute(rows):
    """(doc, kept text, lines, removed) by holding each line against all before it."""
    before, out = [], []
    for doc, text in rows:
        kept, gone = [], 0
        for line in text.split("\n"):
            words = frozenset(line.lower().split())
            like = len(words) >= 5 and any(len(words & b) * 5 >= len(words | b) * 4 for b in before)
            if len(words) >= 5:
                before.append(words)
            gone += like
            if not like:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(text.split("\n")), gone))
    return sorted(out, key=str)


def corpus(seed, variants):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 30)) for _ in range(25)]
    rows = []
    for d in range(60):
        ls = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                w[rng.randrange(len(w))] = prose(rng, 1)
            ls.append(" ".join(w) if rng.random() < variants else prose(rng, 12))
        rows.append((d, "\n".join(ls)))
    return rows


def test_against_brute_force(make, monkeypatch):
    for seed, common, leaders, long in ((1, 1500, 4096, 320), (2, 3, 4096, 320), (3, 3, 2, 320), (4, 1500, 2, 12)):
        monkeypatch.setattr(lines, "COMMON", common)
        monkeypatch.setattr(lines, "LEADERS", leaders)
        monkeypatch.setattr(lines, "LONG", long)
        rows = corpus(seed, 0.7)
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(make(rows).coalesce(1)).collect()), key=str)
        assert got == brute(rows), seed


def test_odd_rows(odd_docs, no_docs):
    got = lines.dedup(odd_docs.coalesce(1)).collect()
    assert len(got) == odd_docs.count() and set(odd_docs.columns) <= set(got[0].asDict())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[1][0].n_lines == 0
    assert [sorted(r.n_removed for r in by[k]) for k in (2, 3, 4, 5, 6)] == [[0], [0], [0, 1], [1], [0]]
    assert lines.dedup(no_docs).count() == 0

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import prose
from weftline.llm import simhash


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, ids):
    a, label = np.array(prints, dtype=np.uint64), np.array(ids)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "A\x0bb\x0cc d É é x", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_print(text)


def ball(rng, n):
    """Fingerprints of which many are a few bits apart, in chains and in dense balls."""
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        x = rng.choice(out[-40:] if rng.random() < 0.7 else out)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


def test_shards_lose_no_pair():
    rng = random.Random(1)
    fps = np.array(ball(rng, 900), dtype=np.uint64)
    vantage = np.array([rng.getrandbits(64) for _ in range(7)], dtype=np.uint64)
    shard, held = simhash.route(fps, vantage, [32] * 7)
    where = {}
    for s, f in zip(shard.tolist(), held.tolist()):
        where.setdefault(f, set()).add(s)
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)):
        assert where[int(fps[i])] & where[int(fps[j])]


def test_components_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    rng = random.Random(2)
    fps = ball(rng, 1200)
    rows = [(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)] + [(5000 + i, f - (f >> 63 << 64)) for i, f in enumerate(fps[:50])]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.cluster(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    ids = [r[0] for r in rows]
    assert [got[i] for i in ids] == slow_components([r[1] % (1 << 64) for r in rows], ids)


def test_odd_rows(odd_docs, no_docs):
    got = simhash.cluster(simhash.fingerprints(odd_docs, ["doc_id"])).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and {by[k].component_id for k in (1, 2, 3)} == {1}
    assert by[5].component_id == 4 and by[None].component_id is None
    assert simhash.cluster(simhash.fingerprints(no_docs, ["doc_id"])).count() == 0


def test_near_copies_meet(make):
    text = prose(random.Random(3), 900)
    rows = simhash.cluster(simhash.fingerprints(make([(1, text), (2, text.upper()), (3, prose(random.Random(4), 900))]), ["doc_id"])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}

"""Line dedup's steps: the nearest earlier line against a plain form, how often texts are dealt and sorted, keys of many blocks."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from weftline.llm import lines
from weftline.llm import linesets as L


def postings(seed, n=300):
    rng = np.random.default_rng(seed)
    key, size = rng.integers(0, 6, n).astype(np.uint64), rng.integers(10, 14, n)
    order = np.argsort(L.place(key, size))
    one = rng.integers(0, 1 << 4, n)
    return L.Postings(key[order], rng.permutation(n)[order], size[order], np.zeros(n, np.int64), rng.random(n) < 0.2, one, one)


@pytest.mark.parametrize("seed", range(5))
def test_nearest_earlier_lines(seed):
    p = postings(seed)
    i, j = (np.concatenate(c) for c in zip(*L._meeting(p)))
    i, j, apart = p.near(i, j)
    found = {}
    for a, b, far in zip(i.tolist(), j.tolist(), apart.tolist()):
        a, b = sorted((a, b), key=lambda k: p.num[k])
        found.setdefault(b, []).append((far, int(p.num[a])))
    want = {(int(p.num[b]), min(f)[1], min(f)[0], len(f) > 1 or bool(p.part[b])) for b, f in found.items()}
    want |= {(int(p.num[k]), -1, 1 << 14, True) for k in np.flatnonzero(p.part) if k not in found}
    assert set(zip(*(c.tolist() for c in L.matches(p)))) == want and len(want) > 20


def test_texts_are_dealt_and_sorted_once(spark, make):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, "one two three four five\nsix"), (1, "one two three four five\nsix"), (2, "one two three four five\n\nseven"), (None, None)]
        out = lines.dedup(make(rows), floor=1)
        plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 2  # the texts and their masks
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
        assert got == [(1, "", 2, 2), (1, "one two three four five\nsix", 2, 0), (2, "\nseven", 3, 1), (None, None, 0, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_of_many_blocks_are_one_batch(monkeypatch):
    """Of a hundred blocks of one posting each."""
    zip_ = zstandard.ZstdCompressor(level=1)
    made = [lines._block({c: np.array([k + 1], np.int64) for c in lines._COLUMNS}, zip_) for k in range(100)]
    ran = []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            ran.extend(run(iter([pa.record_batch({"n": pa.array([1] * 100, pa.int32()), "block": made}), pa.record_batch({"n": pa.array([], pa.int32()), "block": pa.array([], pa.binary())})])))
            return ran

    out = [b.column(0).to_pylist() for b in lines._keys(Frame())]
    assert out == [list(range(1, 101)), []]


def test_words_of_lines():
    text = [b"a b\n\n c  d e\n", None, b"", b"\n", b"x", b" \n y z \t\nq"]
    got = [(int(t), int(k), int(n)) for s in L.sets_of(text) for t, k, n in zip(s.text, s.line, s.n)]
    assert got == [(0, 0, 2), (0, 2, 3), (4, 0, 1), (5, 1, 2), (5, 2, 1)]

import hashlib
import os
import random
from collections import Counter

import pytest
from helpers import prose
from pyspark.sql import functions as F
from weftline.llm import repeats, repeats_kernel


def brute(rows, length):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((d, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    passage = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(5, 60))) for i in range(20)]
    rows += [(100 + i, prose(rng, rng.randint(0, 9)) + " " + passage[rng.randint(0, 30) :] + " " + prose(rng, rng.randint(0, 9))) for i in range(40)]
    rows += [(200, passage), (201, passage), (202, passage + passage), (203, "a" * 1500), (204, "é" * 300), (205, None), (206, "")]
    return rows


@pytest.mark.parametrize("group", [128, 1])
def test_against_brute_force(make, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 1: every key is split down to single strings
    rows = corpus(group)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.strip(make(rows)).collect()), key=str)
    assert got == brute(rows, 400)


def test_covers_against_all_pairs():
    rng = random.Random(5)
    for _ in range(1500):
        n, length = rng.randint(2, 9), rng.randint(6, 9)
        found = set()
        while len(found) < n:
            found.add((b"zz" + bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 7))), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, length - 2)))))
        rights, lefts = zip(*found)
        want = []
        for i in range(n):
            pairs = [(repeats_kernel._common(lefts[i], lefts[j]), repeats_kernel._common(rights[i], rights[j])) for j in range(n) if j != i]
            pairs = [p for p in pairs if sum(p) >= length]
            want.append((max((p[0] for p in pairs), default=0), max((p[1] for p in pairs), default=0)))
        assert repeats_kernel.covers(list(rights), list(lefts), length) == want


def test_anchors_cover_every_string_once():
    rng = random.Random(6)
    for n in (399, 400, 401, 5000):
        raw = bytes(rng.choice(b"abc ") for _ in range(n))
        h, p, left, right = repeats_kernel.anchors(raw)
        starts = [s for a, x, y in zip(p, left, right) for s in range(a - x, a + y - 400 + 1)]
        assert sorted(starts) == list(range(max(0, n - 399)))


def test_odd_rows(odd_docs, no_docs):
    got = repeats.strip(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.doc_id: r.n_bytes for r in got}[1] == 0
    assert [r.n_removed for r in got if r.doc_id == 6] == [150_000]
    assert repeats.strip(no_docs).count() == 0


def test_groups_of_one_anchor_against_all_pairs():
    rng = random.Random(11)
    for _ in range(300):
        length, n = rng.choice((3, 5)), rng.randint(1, 9)
        made = {(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))), bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 5)))) for _ in range(n)}
        lefts, rights = ([m[k] for m in sorted(made)] for k in (0, 1))
        got = sorted((a, b, sorted(m)) for a, b, m in repeats_kernel.repeat_groups(rights, lefts, length))
        want = set()
        for i in range(len(lefts)):
            for j in range(i):
                a, b = (len(os.path.commonprefix((x[i], x[j]))) for x in (lefts, rights))
                if a + b >= length:
                    want.add((a, b, tuple(k for k in range(len(lefts)) if lefts[k][:a] == lefts[i][:a] and rights[k][:b] == rights[i][:b] and len(lefts[k]) >= a and len(rights[k]) >= b)))
        assert got == sorted((a, b, list(m)) for a, b, m in want)


def test_groups_tell_all_occurrences(make, monkeypatch):
    rng = random.Random(12)
    rows = [(d, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for d in range(30)]
    rows += [(40 + k, rows[0][1]) for k in range(3)] + [(50, None)]
    for limit in (128, 2):
        monkeypatch.setattr(repeats, "GROUP", limit)
        found = {}
        for r in repeats.groups(make(rows), length=40).collect():
            found.setdefault((r.group, r.length), set()).add((r.doc_id, r.start))
        texts = {d: (t or "").encode() for d, t in rows}
        told = set()
        for (_, n), at in found.items():
            strings = {texts[d][s : s + n] for d, s in at}
            assert len(strings) == 1 and len(at) > 1
            every = {(d, s) for d, t in texts.items() for s in range(len(t) - n + 1) if t[s : s + n] in strings}
            assert at == every
            told |= {(d, s + k) for d, s in at for k in range(n)}
        seen = {}
        for d, t in texts.items():
            for s in range(len(t) - 39):
                seen.setdefault(t[s : s + 40], []).append((d, s))
        assert told == {(d, s + k) for at in seen.values() if len(at) > 1 for d, s in at for k in range(40)}


def test_hot_anchor_is_dealt_to_many_tasks(make, spark, monkeypatch):
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "adaptive.advisoryPartitionSizeInBytes": "4k"}
    contexts, dealt = repeats._contexts, []

    def seen(base, shared):
        dealt.extend(shared.withColumn("task", F.spark_partition_id()).collect())
        return contexts(base, shared)

    monkeypatch.setattr(repeats, "_contexts", seen)
    rows = [(i, "a" * 1000) for i in range(40)]  # an anchor at each place, all of one hash
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = repeats.strip(make(rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert len({r.hash for r in dealt}) == 1 and len(dealt) == 40 * 601
    assert max(Counter(r.task for r in dealt).values()) < len(dealt) / 2
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(i, 1000, 1000, 1) for i in range(40)]

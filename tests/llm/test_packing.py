import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from weftline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    plain = [c for c in map(chr, range(9, 0x180)) if packing._PLAIN.fullmatch(c)] + ["'"] * 60 + [" "] * 40 + list("stremvld") * 5
    texts = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(20)) for _ in range(200)]
    texts += ["It's 2²³ DON'T o'clock ''s 'tion", "x<|endoftext|>y", "a\x85b\xa0c", "İıŉſ", "é", "", "Σς ΟΔΟΣ"]
    known = packing.words(PATH)
    for t in texts:
        want = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        assert known.ids(t) == want, t


def check_bins(counts, groups, capacity):
    places, rank, bins = packing.Places(groups), Counter(), defaultdict(list)
    for n, c in counts.items():
        s, o = places.of(np.full(c, n), np.arange(c))
        for a, b in zip(s.tolist(), o.tolist()):
            bins[a].append((b, n))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in held) <= 2
    assert sum(len(b) for b in bins.values()) == sum(counts.values())
    return len(bins)


def test_plans():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice((10, 64, 2048))
        counts = {n: rng.choice((0, 1, 2, 3, 50)) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 60)))}
        counts = {n: c for n, c in counts.items() if c}
        used = check_bins(counts, packing.plan(counts, capacity), capacity)
        large = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert used <= 1.34 * max(large, -(-sum(n * c for n, c in counts.items()) // capacity)) + 2
    assert packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({2049: 1})


def test_round_trip(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = defaultdict(list)
    bins = defaultdict(int)
    for r in packing.pack(docs, PATH, ["doc_id"], with_ids=True).collect():
        parts[r.doc_id].append(r)
        bins[r.sequence_id] += r.length
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
    for d in docs.collect():
        ids = b"".join(r.ids for r in sorted(parts[d.doc_id], key=lambda r: r.piece))
        assert ids == np.array([*tokenizer.encode(d.text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        assert [r.start for r in sorted(parts[d.doc_id], key=lambda r: r.piece)] == list(range(0, len(ids) // 4, 2048))
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_odd_rows(odd_docs, no_docs):
    got = packing.pack(odd_docs.drop("length"), PATH, ["doc_id"]).collect()
    assert sorted(r.length for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(r.doc_id == 4 for r in got) == 2 and sum(r.doc_id == 6 for r in got) == -(-30_002 // 2048)
    assert packing.pack(no_docs, PATH, ["doc_id"]).count() == 0

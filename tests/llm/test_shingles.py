import random

import corpus_pipeline
from helpers import prose
from weftline.llm import shingles


def grams(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """The smallest id of each group, all texts held against all."""
    sets, label = [grams(t) for _, t in rows], [i for i, _ in rows]
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) * 5 >= len(a | b) * 4] for a in sets]
    while True:
        new = [min(label[j] for j in at) for at in near]
        if new == label:
            return sorted(set(label))
        label = new


def corpus(seed):
    """Texts of which many are copies of others with a few words changed, near the threshold on either side."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(20)] + ["", " "]
    while len(texts) < 150:
        w = rng.choice(texts).split()
        for _ in range(rng.randint(0, max(1, len(w) // 30))):
            if w:
                w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    return list(enumerate(texts))


def test_near_dedup_against_all_pairs(spark, make):
    for seed in (1, 2):
        rows = corpus(seed)
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows), "").collect()) == brute(rows), seed


def test_any_order_of_shingles_is_right(spark, make, monkeypatch):
    monkeypatch.setattr(shingles, "_BUCKET", shingles.np.uint64(62))
    rows = corpus(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows), "").collect()) == brute(rows)


def test_dealt_and_common_shingles_are_right(spark, make, monkeypatch):
    """All shingles are dealt, and over two sets are common: firsts of parts, pairs of shingles and cells do the work."""
    for common, long in ((2, 320), (3, 40)):
        monkeypatch.setattr(shingles, "HOT", 1 << 40)
        monkeypatch.setattr(shingles, "PARTS", 3)
        monkeypatch.setattr(shingles, "COMMON", common)
        monkeypatch.setattr(shingles, "LONG", long)
        monkeypatch.setattr(shingles, "_by_simhash", lambda survey: spark.createDataFrame([], "a long, b long"))
        rows = corpus(4)
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows), "").collect()) == brute(rows), (common, long)


def test_no_part_of_a_shared_shingle_has_all_of_it(spark, make, monkeypatch):
    """A passage in a third of all texts: its shingles are dealt, and nothing of it is lost."""
    rng = random.Random(5)
    shared = prose(rng, 8)
    rows = [(i, f"{shared} {prose(rng, rng.randint(1, 4))}" if i % 3 == 0 else prose(rng, 40)) for i in range(600)]
    base = make(rows).selectExpr("doc_id AS __row", "text")
    monkeypatch.setattr(shingles, "PARTS", 8)
    counts = shingles.np.zeros(shingles.BUCKETS, shingles.np.int64)
    for _, s in ((0, s) for s in shingles.L.shingle_sets([t.encode() for _, t in rows], 5)):
        counts += shingles.np.bincount((s.words >> shingles._BUCKET).astype(shingles.np.int64), minlength=shingles.BUCKETS)
    post = shingles._postings(base, counts, 64)
    by_key = [r["count"] for r in post.groupBy("key").count().collect()]
    by_part = [r["count"] for r in post.groupBy("key", "part").count().collect()]
    assert max(by_key) >= 80 and max(by_part) < max(by_key) / 3
    monkeypatch.setattr(shingles, "COMMON", 16)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows), "").collect()) == brute(rows)

import hashlib
import random
import re

from helpers import prose
from weftline.llm import decontamination


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            b = words(it)
            n = min(13, len(b))
            for window in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit.update(range(k, k + n))
                        if i is not None:
                            found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.__getitem__("__n"), r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    few = [f"w{i}" for i in range(6)]  # so few words that grams come back by chance
    items = [(i, prose(rng, rng.choice((13, 14, 20, 40)))) for i in range(12)] + [(20, prose(rng, 5)), (21, prose(rng, 9)), (22, prose(rng, 12)), (23, ""), (24, None), (25, "!?")]
    items += [(i + 30, items[i][1].upper()) for i in range(3)] + [(40, " ".join(rng.choice(few) for _ in range(30))), (None, items[2][1])]
    docs = []
    for d in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [", ".join(w[a : a + rng.choice((6, 12, 13, 25, 99))]), prose(rng, rng.randint(0, 10))]
        docs.append((d, " - ".join(parts)))
    docs += [(100 + k, " ".join(rng.choice(few) for _ in range(60))) for k in range(10)] + [(200, None), (201, ""), (202, "Éa " * 40), (203, items[0][1]), (203, items[0][1])]
    return docs, items


def test_against_brute_force(make):
    docs, items = corpus(1)
    assert result(decontamination.measure(make(docs), make(items, "item_id long, text string"))) == brute(docs, items)


def test_large_sides_go_by_shuffle(make, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    docs, items = corpus(2)
    assert result(decontamination.measure(make(docs), make(items, "item_id long, text string"))) == brute(docs, items)


def test_odd_rows(odd_docs, no_docs, make):
    items = make([(1, "Same text here"), (2, None)], "item_id long, text string")
    got = decontamination.measure(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and sum(r.contaminated for r in got) == 3 and all(r.score == 1 for r in got)
    assert decontamination.measure(no_docs, items).count() == 0
    assert not any(r.contaminated for r in decontamination.measure(odd_docs, make([], "item_id long, text string")).collect())


def test_empty_benchmark_without_adaptive_execution(spark, odd_docs, make):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for items in ([], [(1, None), (2, " -- ")]):
            got = decontamination.measure(odd_docs, make(items, "item_id long, text string")).collect()
            assert len(got) == odd_docs.count() and not any(r.contaminated or r.n_hit or r.n_items for r in got)
        docs, items = corpus(3)
        assert result(decontamination.measure(make(docs), make(items, "item_id long, text string"))) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_repeated_words_take_linear_time(make):
    """A document of 20,000 equal words and one of 5,000 copies of a sentence, items of 300 and of 5 equal words, and a long item that holds
    the sentence fifty times."""
    said = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    docs = [(1, "spam " * 20_000), (2, " ".join(said * 5_000)), (3, "spam " * 12 + "ham " + " ".join(said[:12])), (4, "clean words only")]
    items = [(1, "spam " * 300), (2, "spam " * 5), (3, " ".join(said * 50)), (4, " ".join(said[3:] + said[:3]))]
    got = {r.doc_id: (r["__n"], r.n_hit, r.n_items) for r in decontamination.measure(make(docs), make(items, "item_id long, text string")).collect()}
    # the item of five words is hit in the twelve of document 3, no window of thirteen is
    assert got == {1: (20_000, 20_000, 2), 2: (70_000, 70_000, 2), 3: (25, 12, 1), 4: (3, 0, 0)}


def test_main_path_has_no_python(spark, sf):
    from weftline.llm import registry

    plan = registry.op10_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

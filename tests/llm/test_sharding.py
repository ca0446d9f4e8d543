import hashlib
from collections import Counter

import pytest
from weftline.llm import sharding


def slow_table(names, size):
    prefer = {}
    for n in names:
        d = hashlib.md5(n.encode()).hexdigest()
        start, step = int(d[:8], 16) % size, int(d[8:16], 16) % (size - 1) + 1
        prefer[n] = [(start + k * step) % size for k in range(size)]
    table = {}
    while len(table) < size:
        for n in sorted(names):
            if len(table) < size:
                table[next(s for s in prefer[n] if s not in table)] = n
    return [table[i] for i in range(size)]


def test_table_against_plain_form():
    for names, size in ((["a"], 2), (["b", "a", "c"], 13), ([f"s{i}" for i in range(10)], 211)):
        assert [names[o] for o in sharding.fill_table(names, size)] == slow_table(names, size)


def test_even_and_steady():
    owner = sharding.fill_table()
    load = Counter(owner)
    assert max(load.values()) - min(load.values()) <= 1
    fewer = sharding.fill_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 63)
    assert moved < 0.25 * len(owner)
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 3)):
        with pytest.raises(ValueError):
            sharding.fill_table(*wrong)


def test_query(spark, sf):
    from weftline.llm import registry

    table = [sharding.SHARDS[o] for o in sharding.fill_table()]
    rows = registry.op5_sharding(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.TABLE_SIZE and r.shard == table[r.slot] for r in rows)


def test_odd_rows(odd_docs, no_docs):
    got = sharding.place(odd_docs.withColumnRenamed("score", "slot")).collect()
    assert len(got) == odd_docs.count() and len({r.shard for r in got if r.doc_id == 4}) == 1
    assert sharding.place(no_docs).count() == 0

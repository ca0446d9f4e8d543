"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity; two sets of Jaccard similarity 0.8 share a word among the first
few of both (prefix filter), at places that leave room for the overlap (positional filter, which implies that of lengths).  A
parity sketch of each set bounds the symmetric difference from below and drops nearly all other pairs, none wrongly.  What is
left is verified on the full sets.  A line that is like an earlier one is removed.

Only distinct sets take part, under numbers in the order of their first lines.  Rarity is counted over all lines in a fixed
number of buckets; any order is right, a good one is fast.  A word of more than ``COMMON`` lines is looked up together with
each next word of a prefix longer by one, which is exact too.  The sets of a key that may have more than ``LEADERS`` are dealt
to parts; a set that has found no match in its own part asks all others.  A line needs one earlier match only: each lookup
names the nearest, the nearest of all is verified, and all others only for lines of which it did not hold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import linesets as L
from weftline.llm.common import drop_written, released, written
from weftline.llm.linesets import SIMILAR, prefix_of
from weftline.llm.shingles import SHINGLE

__all__ = ["SIMILAR", "prefix_of", "dedup"]

#: lines of fewer words are like equal ones only, so they are not looked up; also the default floor of :func:`dedup`
MIN_WORDS = 5
#: lines of a word that is looked up by itself, at most
COMMON = 4096
#: lines of so many words are looked up by single words, however common; lines of fewer than LONG * 5 / 4 as all others
LONG = 320
#: lines of a key from which it is dealt to parts
LEADERS = 8192
#: bytes of a word in a packed prefix and in a packed set
_TOKEN, _WORD = 5, 7
#: for a copy: of its words one in so many at least comes from its source, and the sizes of both, as a fraction
_SHARE, _SIZES = 10, (3, 5)
#: rows of (long) that may be broadcast: 16 MB at most; more go by a filter of fixed size
BROADCAST_ROWS = 1_000_000
#: fixed sizes: parts of a table that tasks add up, bits of a filter
_CHUNKS, _BITS = 64, 1 << 25
#: rows of texts that a task turns into Python's objects at once; postings that it holds back to hand them on in blocks
_ROWS, _HELD = 512, 1 << 18
#: fixed values: white space that parts words, letters that are lower-cased
_BLANK, _UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _added(rows: DataFrame, dtype: str, join) -> np.ndarray:
    """The element-wise ``join`` of the tables whose compressed ``_CHUNKS`` parts are in ``rows`` (chunk int, z binary): of fixed size, whatever the input."""

    def run(batches):
        unzip, zip_, held, total = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), None, None
        for b in batches:
            for chunk, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(unzip.decompress(z), dtype)
                if chunk != held:
                    if held is not None:
                        yield pa.RecordBatch.from_pydict({"chunk": pa.array([held], pa.int32()), "z": [zip_.compress(total.tobytes())]})
                    held, total = chunk, part.copy()
                else:
                    join(total, part, out=total)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([held], pa.int32()), "z": [zip_.compress(total.tobytes())]})

    whole = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(released(run), "chunk int, z binary").toArrow().sort_by("chunk")
    unzip = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(unzip.decompress(z), dtype) for z in whole.column("z").to_pylist()]) if whole.num_rows else np.zeros(0, dtype)


def _chunks(table: np.ndarray) -> pa.RecordBatch:
    zip_ = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_pydict({"chunk": pa.array(range(_CHUNKS), pa.int32()), "z": [zip_.compress(x.tobytes()) for x in table.reshape(_CHUNKS, -1)]})


def _filter(values: DataFrame) -> np.ndarray:
    """A Bloom filter of the long column of ``values``; its size does not hang on theirs."""

    def run(batches):
        bits = np.zeros(_BITS, bool)
        for b in batches:
            for at in _cells(b.column(0).to_numpy()):
                bits[at] = True
        yield _chunks(np.packbits(bits))

    return _added(values.mapInArrow(released(run), "chunk int, z binary"), "u1", np.bitwise_or)


def _cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = L.mix(values.view(np.uint64), 9)
    return (h & np.uint64(_BITS - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(_BITS - 1)).astype(np.int64)


def _inside(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(bits):
        return np.zeros(len(values), bool)
    return np.logical_and.reduce([(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) for at in _cells(values)])


def _raw(b: pa.RecordBatch, column: int):
    """(first row, texts as bytes) of a batch, some rows at a time."""
    for at in range(0, b.num_rows, _ROWS):
        yield at, b.column(column).slice(at, _ROWS).cast(pa.binary()).to_pylist()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the size of each value."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(ends).astype(np.int64)


def _ranks(texts: DataFrame) -> np.ndarray:
    """How common the words of each bucket are, over all texts."""

    def run(batches):
        counts = np.zeros(1 << L.BUCKET_BITS, np.uint32)
        for b in batches:
            for _, texts_ in _raw(b, 0):
                for h in L.words_of(texts_):
                    np.add.at(counts, L.bucket(h), np.uint32(1))
        yield _chunks(counts)

    found = _added(texts.select("__text").mapInArrow(released(run), "chunk int, z binary"), "<u4", np.add)
    return L.ranks(found) if len(found) else np.zeros(1 << L.BUCKET_BITS, np.uint8)


def _sets(texts: DataFrame, floor: int, rank: np.ndarray, half: int) -> DataFrame:
    """The distinct sets (num, id and id2: the halves of its name, first: where it comes first, prefix, n: words, one and two: sketches), numbered in that order."""
    sent = texts.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        seen = sent.value
        for b in batches:
            for at, texts_ in _raw(b, 2):
                for s in L.sets_of(texts_, floor):
                    one, two = s.ids(half)
                    new = np.zeros(len(one), bool)
                    new[np.unique(one, return_index=True)[1]] = True  # others go without their prefix, which is the same
                    fresh = s.only(new & (s.n >= MIN_WORDS))  # smaller sets are not looked up
                    take, token = L.prefixes(fresh, seen)
                    sizes = np.zeros(len(one), np.int64)
                    sizes[new & (s.n >= MIN_WORDS)] = take * _TOKEN
                    of, (s1, s2) = pa.array(s.text + at), s.sketches()
                    columns = [pa.array(one), pa.array(two), b.column(0).take(of), b.column(1).take(of), pa.array(s.line, pa.int64()), L.binaries(L.packed(token, _TOKEN), sizes), pa.array(s.n), pa.array(s1), pa.array(s2)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "id2", "by", "tie", "line", "prefix", "n", "one", "two"])

    by = texts.schema["__by"].dataType.simpleString()
    rows = texts.select("__by", "__tie", "__text").mapInArrow(released(run), f"id long, id2 long, by {by}, tie long, line long, prefix binary, n long, one long, two long")
    sets = rows.groupBy("id", "id2").agg(F.min(F.struct("by", "tie", "line")).alias("first"), F.max(F.struct("prefix", "n", "one", "two")).alias("set"))
    plain = written(sets.select("id", "id2", "first", "set.*"), "sets")  # sorting looks at it twice
    places = [f"first.by.`{c}`" for c in plain.schema["first"].dataType["by"].dataType.names] + ["first.tie", "first.line"]  # by columns of their own, which Spark sorts by their bits
    ordered = written(plain.sort(*places).select(F.monotonically_increasing_id().alias("num"), *plain.columns), "sets")
    drop_written(plain)
    return ordered


#: a posting's columns and the bytes that each takes in a block; size: words << 21 | place << 1 | whether the key has parts
_COLUMNS = {"key": 5, "num": 8, "size": 8, "one": 8, "two": 8}


def _block(columns: dict[str, np.ndarray], zip_) -> bytes:
    """Postings as bytes: column by column, and of each column first all the lowest bytes."""
    return zip_.compress(b"".join(np.ascontiguousarray(L.packed(columns[c].view(np.uint64), k).T).tobytes() for c, k in _COLUMNS.items()))


def _unblock(z: bytes, n: int, unzip) -> dict[str, np.ndarray]:
    raw, at, out = np.frombuffer(unzip.decompress(z), np.uint8), 0, {}
    for c, k in _COLUMNS.items():
        out[c] = L.unpacked(np.ascontiguousarray(raw[at : at + n * k].reshape(k, n).T).reshape(-1), k)
        at += n * k
    return out


def _postings(sets: DataFrame, sizes: tuple[int, int, int, int], ask: bool = False, only: np.ndarray | None = None) -> DataFrame:
    """The lookups of ``sets`` in blocks by bucket of their key (bucket, n, ask, block); with ``ask`` in all parts of
    their keys, with ``only`` (a filter) of its keys."""
    sent = sets.sparkSession.sparkContext.broadcast((sizes, only))

    def run(batches):
        (common, long, leaders, buckets), wanted = sent.value
        held, rows, zip_ = [], 0, zstandard.ZstdCompressor(level=1)

        def blocks():
            whole = {c: np.concatenate([h[c] for h in held]) for c in _COLUMNS}
            bucket = (whole["key"] % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            whole = {c: v[order] for c, v in whole.items()}
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(bucket) else [0]
            made = [_block({c: v[a:z] for c, v in whole.items()}, zip_) for a, z in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int64)), pa.array(np.diff(edges), pa.int32()), pa.array([ask] * len(made), pa.bool_()), pa.array(made, pa.binary())], names=["bucket", "n", "ask", "block"])

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                num, n, one, two = (part.column(c).to_numpy() for c in (0, 2, 3, 4))
                raw, count = _bytes_of(part.column(1))
                token, count = L.unpacked(raw, _TOKEN), count // _TOKEN
                of, key, pos, lines = L.lookups(n, count, token, common, long)
                parts = np.maximum(1, np.ceil(lines / leaders)).astype(np.int64)
                if ask:
                    again = np.repeat(np.arange(len(of)), parts)
                    part = np.arange(len(again)) - (np.cumsum(parts) - parts)[again]
                    of, key, pos, parts = of[again], key[again], pos[again], parts[again]
                else:
                    part = (L.mix(num.view(np.uint64), 8)[of] % parts.astype(np.uint64)).astype(np.int64)
                key = L.mix(key + part.astype(np.uint64), 10) >> np.uint64(24)
                if wanted is not None:
                    of, key, pos, parts = (c[ok] for ok in [_inside(wanted, key.view(np.int64))] for c in (of, key, pos, parts))
                size = (n[of] << 21) | (np.minimum(pos, (1 << 20) - 1) << 1) | (parts > 1)
                held.append({"key": key, "num": num[of], "size": size, "one": one[of], "two": two[of]})
                rows += len(of)
                if rows > _HELD:
                    yield blocks()
                    held, rows = [], 0
        if rows:
            yield blocks()

    return sets.select("num", "prefix", "n", "one", "two").mapInArrow(released(run), "bucket long, n int, ask boolean, block binary")


def _keys(post: DataFrame) -> DataFrame:
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            keys = [_unblock(z, n, unzip)["key"] for n, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]  # a block may hold few
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))})

    return post.select("n", "block").mapInArrow(released(run), "key long")


def _matches(post: DataFrame) -> DataFrame:
    """(x, y, far, more) by :func:`weftline.llm.linesets.matches`, bucket by bucket."""

    def work(blocks: list[tuple[int, bool, bytes]], unzip) -> pa.RecordBatch:
        parts = [_unblock(z, n, unzip) for n, _, z in blocks]
        c = {k: np.concatenate([p[k] for p in parts]) for k in _COLUMNS}
        asks = np.repeat([a for _, a, _ in blocks], [n for n, _, _ in blocks])
        order = np.argsort(L.place(c["key"], c["size"] >> np.uint64(21)))
        c, size = {k: v[order] for k, v in c.items()}, c["size"][order].astype(np.int64)
        asks = asks[order]
        p = L.Postings(c["key"], c["num"].view(np.int64), size >> 21, (size >> 1) & ((1 << 20) - 1), (size & 1).astype(bool), c["one"], c["two"], asks if asks.any() else None)
        x, y, far, more = L.matches(p)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(far.astype(np.int32)), pa.array(more)], names=["x", "y", "far", "more"])

    def run(batches):
        unzip, held, blocks = zstandard.ZstdDecompressor(), None, []
        for b in batches:
            for bucket, *block in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != held and blocks:
                    yield work(blocks, unzip)
                    blocks = []
                held = bucket
                blocks.append(block)
        if blocks:
            yield work(blocks, unzip)

    return post.select("bucket", "n", "ask", "block").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(released(run), "x long, y long, far int, more boolean")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, floor: int, half: int) -> DataFrame:
    """Those of ``pairs`` (x, y) whose sets are similar enough, written."""
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.col("x").alias("a")).union(pairs.select("y")).distinct()
    known = written(sets.select("num", "id", "id2", F.col("first.tie").alias("w")).join(asked, F.col("num") == F.col("a")).drop("a"), "asked")  # the large table is dealt once
    a, b = (known.select(F.col("num").alias(f"{k}_"), F.col("id").alias(f"{k}i"), F.col("id2").alias(f"{k}j")) for k in "xy")
    named = written(pairs.join(a, F.col("x") == F.col("x_")).join(b, F.col("y") == F.col("y_")).select("x", "y", "xi", "xj", "yi", "yj"), "pairs")
    rows, ids = written(known.select("w").distinct(), "rows"), known.select("id")
    few = rows.count() <= BROADCAST_ROWS
    if few:  # texts in which one of the sets comes first
        texts = texts.join(F.broadcast(rows), F.col("__tie") == F.col("w"), "left_semi")
    sent = sets.sparkSession.sparkContext.broadcast((None if few else _filter(rows), _filter(ids)))

    def words(batches):
        (rows, wanted), done = sent.value, set()
        for b in batches:
            if rows is not None:
                b = b.filter(pa.array(_inside(rows, b.column(0).to_numpy())))
            for _, texts_ in _raw(b, 1):
                for s in L.sets_of(texts_, floor):
                    one, two = s.ids(half)
                    use = _inside(wanted, one)
                    use[use] = [not (i in done or done.add(i)) for i in zip(one[use].tolist(), two[use].tolist())]
                    s, one, two = s.only(use), one[use], two[use]
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), L.binaries(L.packed(s.words, _WORD), s.n * _WORD)], names=["id", "id2", "words"])

    def judge(batches):
        for b in batches:
            ok = pa.array(L.similar(b.column(2).to_pylist(), b.column(3).to_pylist(), _WORD))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["x", "y"])

    full = texts.select("__tie", "__text").mapInArrow(released(words), "id long, id2 long, words binary").dropDuplicates(["id", "id2"])
    a, b = (full.select(F.col("id").alias(f"{k}_"), F.col("id2").alias(f"{k}_2"), F.col("words").alias(f"{k}w")) for k in "xy")
    both = named.join(a, (F.col("xi") == F.col("x_")) & (F.col("xj") == F.col("x_2"))).join(b, (F.col("yi") == F.col("y_")) & (F.col("yj") == F.col("y_2"))).select("x", "y", "xw", "yw")
    found = written(both.mapInArrow(released(judge), "x long, y long"), "gone")
    for t in (pairs, known, named, rows):
        drop_written(t)
    return found


def _roots(links: DataFrame) -> DataFrame:
    """(x, y): the end of the chain that leads from x, by the earliest of its ``links`` (x, y; y is before x), written."""
    up = written(links.groupBy("x").agg(F.min("y").alias("y")), "roots")
    while True:
        above = up.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
        new = written(up.join(above, F.col("y") == F.col("x2"), "left").select("x", F.coalesce("y2", "y").alias("y"), F.col("y2").isNotNull().alias("moved")), "roots")
        drop_written(up)
        up = new
        if up.where("moved").isEmpty():
            return up


def _sources(sets: DataFrame, texts: DataFrame, floor: int, links: DataFrame, half: int) -> DataFrame:
    """(tie, src, n, lines) of each different text: its lines that come from the text ``src``, and their words.  A line comes from the
    text of the earliest line that a chain of like ones (``links``: x, y) leads to; that one stays."""

    def run(batches):
        for b in batches:
            for at, texts_ in _raw(b, 1):
                for s in L.sets_of(texts_, floor):
                    one, two = s.ids(half)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s.text + at)), pa.array(s.line, pa.int64()), pa.array(one), pa.array(two), pa.array(s.n, pa.int64())], names=["tie", "line", "id", "id2", "n"])

    heads = sets.select(F.col("num").alias("head"), F.col("first.tie").alias("src"))
    roots = _roots(links)
    chained = roots.join(heads, F.col("y") == F.col("head")).select(F.col("x").alias("node"), "src")
    origin = sets.join(chained, F.col("num") == F.col("node"), "left").select(F.col("id").alias("i"), F.col("id2").alias("j"), F.coalesce("src", "first.tie").alias("src"))
    every = texts.select("__tie", "__text").mapInArrow(released(run), "tie long, line long, id long, id2 long, n long").distinct()  # equal texts count once
    found = written(every.join(origin, (F.col("id") == F.col("i")) & (F.col("id2") == F.col("j"))).groupBy("tie", "src").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("tie") != F.col("src"), F.col("line"))).alias("lines")), "sources")
    drop_written(roots)
    return found


def _copies(sets: DataFrame, texts: DataFrame, floor: int, links: DataFrame, kept: DataFrame, half: int) -> DataFrame:
    """``kept`` (tie, mask) with the lines that copies have from their source.

    The source of a text of which something stays is the one that most of its other words come from.  It is a copy if that and the lines that it
    has from its source are near what stays of the source, which is no copy: by the sets of shingles of
    :mod:`weftline.llm.shingles`, so that :func:`weftline.llm.shingles.groups` joins the two."""
    parts = _sources(sets, texts, floor, links, half)
    whole = parts.where("tie = src").select(F.col("tie").alias("w"), F.col("n").alias("own"))
    best = parts.where("tie <> src").groupBy("tie").agg(F.max_by(F.struct("src", "n", "lines"), F.struct("n", "src")).alias("b")).select("tie", "b.*")
    sized = best.join(whole, F.col("tie") == F.col("w")).select("tie", "src", "lines", "n", (F.col("n") + F.col("own")).alias("all"))
    pairs = sized.join(whole, F.col("src") == F.col("w")).where(f"n * {_SHARE} >= all and least(all, own) * {_SIZES[1]} >= greatest(all, own) * {_SIZES[0]}").select("tie", "src", "lines")
    masks = kept.select(F.col("tie").alias("k"), "mask")

    def mark(batches):
        for b in batches:
            made = []
            for mask, lines in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out = np.zeros(max(len(mask), max(lines) + 1), np.uint8)
                out[: len(mask)] = np.frombuffer(mask, np.uint8)
                out[lines] = 1
                made.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), *b.columns[3:]], names=["tie", "mask", *b.schema.names[3:]])

    pairs = pairs.join(masks, F.col("tie") == F.col("k")).select("tie", "mask", "lines", "src").mapInArrow(released(mark), "tie long, mask binary, src long")
    pairs = written(pairs, "copies")
    asked = pairs.select("tie", "mask", F.lit(True).alias("copy")).union(masks.join(pairs.select("src").distinct(), F.col("k") == F.col("src"), "left_semi").select("k", "mask", F.lit(False)))
    asked = written(asked, "asked")
    ties = asked.select(F.col("tie").alias("t")).distinct()

    def shingled(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                left = []
                for t, mask in zip(*(b.column(k).slice(at, 256).to_pylist() for k in (2, 3))):
                    left.append(b"\n".join(x for x, m in zip(t.encode().split(b"\n"), mask) if m))
                for s in L.shingle_sets(left, SHINGLE):
                    of = pa.array(s.text + at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), L.binaries(L.packed(s.words, _WORD), s.n * _WORD)], names=["tie", "copy", "words"])

    def judge(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ok = pa.array(L.similar(b.column(2).to_pylist(), b.column(3).to_pylist(), _WORD))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["tie", "src"])

    few = F.broadcast(ties) if asked.count() <= BROADCAST_ROWS else ties
    some = texts.select("__tie", "__text").join(few, F.col("__tie") == F.col("t"), "left_semi").dropDuplicates(["__tie"])
    full = written(some.join(asked, F.col("__tie") == F.col("tie")).select("tie", "copy", "__text", "mask").mapInArrow(released(shingled), "tie long, copy boolean, words binary"), "shingled")
    a, b = (full.where(F.col("copy") == k).select(F.col("tie").alias(f"t{int(k)}"), F.col("words").alias(f"w{int(k)}")) for k in (True, False))
    near = pairs.select("tie", "src").join(a, F.col("tie") == F.col("t1")).join(b, F.col("src") == F.col("t0")).select("tie", "src", "w1", "w0")
    near = written(near.mapInArrow(released(judge), "tie long, src long"), "near")
    found = near.join(near.select(F.col("tie").alias("c")), F.col("src") == F.col("c"), "left_anti").select(F.col("tie").alias("c"))
    more = pairs.join(found, F.col("tie") == F.col("c"), "left_semi").select(F.col("tie").alias("c"), F.col("mask").alias("m"))
    out = written(kept.select("tie", "mask").join(more, F.col("tie") == F.col("c"), "left").select("tie", F.coalesce("m", "mask").alias("mask")), "kept")
    for t in (parts, pairs, asked, full, near, kept):
        drop_written(t)
    return out


def _kept(sets: DataFrame, texts: DataFrame, floor: int, sizes: tuple[int, int, int, int], copies: bool = False, half: int = 64) -> DataFrame:
    """(by, tie, mask, n): the lines that stay, of each different text, as a byte for each line up to the last of them; with
    ``copies`` (tie, mask) of :func:`_copies`; written."""
    spark = sets.sparkSession
    near = _matches(_postings(sets, sizes)).groupBy("x").agg(F.min(F.struct("far", "y")).alias("b"), F.max("more").alias("more"), F.min(F.nullif("y", F.lit(-1))).alias("low"), F.max("y").alias("high"))
    near = written(near.select("x", F.col("b.y").alias("y"), (F.col("more") | (F.col("low") < F.col("high"))).alias("more")), "named")
    gone = [_verified(near.where("y >= 0").select("x", "y"), sets, texts, floor, half)]
    open_ = written(near.where("more").select(F.col("x").alias("o")).join(gone[0], F.col("o") == F.col("x"), "left_anti"), "open")
    drop_written(near)
    if not open_.isEmpty():
        asking = _postings(sets.join(open_, F.col("num") == F.col("o"), "left_semi"), sizes, ask=True)
        post = _postings(sets, sizes, only=_filter(_keys(asking)))
        rest = written(_matches(post.union(asking)).select("x", "y").distinct(), "rest")
        gone.append(_verified(rest, sets, texts, floor, half))
        drop_written(rest)
    all_gone = reduce(DataFrame.union, gone).select(F.col("x").alias("g"))
    stay = sets.select("num", "first").join(all_gone, F.col("num") == F.col("g"), "left_anti")
    lists = stay.groupBy(F.col("first.by").alias("by"), F.col("first.tie").alias("tie")).agg(F.collect_list("first.line").alias("lines"))

    def masks(batches):
        for b in batches:
            made = []
            for lines in b.column(2).to_pylist():
                mask = np.zeros(max(lines) + 1, np.uint8)
                mask[lines] = 1
                made.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.compute.list_value_length(b.column(2)).cast(pa.int64())], names=["by", "tie", "mask", "n"])

    kept = written(lists.mapInArrow(released(masks), f"by {lists.schema['by'].dataType.simpleString()}, tie long, mask binary, n long"), "kept")
    if copies:
        kept = _copies(sets, texts, floor, reduce(DataFrame.union, gone), kept, half)
    for t in (open_, *gone):
        drop_written(t)
    return kept


def dedup(docs: DataFrame, text: str = "text", floor: int = MIN_WORDS, order: tuple[str, ...] | None = None, counts: tuple[str, str] = ("n_lines", "n_removed"), copies: bool = False, half: int = 64) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, and two columns named by ``counts``: its lines, and those removed.

    A line goes if its set of words (A-Z lower-cased, parted by ASCII white space) is equal to that of an earlier line, or of
    Jaccard similarity 0.8 or more to it, in any row, removed or not.  Earlier is by the columns ``order`` (doc_id where there
    is one; nulls first), then by a hash of the text, then by the place in it, so that neither files nor partitions count;
    of rows equal in all that, one is the first.  Lines of fewer than ``floor`` different words always stay; with 1, as op1
    and the pipeline have it, those are the blank ones only.  Null texts stay null and have no lines; a text all of whose
    lines go becomes empty.  An empty table gives no rows.  Other columns keep their values, whatever their names.

    With ``copies`` lines go from texts, not from copies of texts: equal texts lose the same lines, and one that is a near copy
    of an earlier text as a whole, with lines of its own (:func:`_copies`), keeps those that it has from it.  The near-dedup
    finds them and drops them whole; without that, what differs in a near copy would stay as a text of its own.

    Sets are named by 128 bits.  Texts are named by 64; those whose names clash are told by another 64 and keep all their lines: a
    few in ten billion.  ``half``: bits that are used of the first half of a name (fewer in tests, for clashes)."""
    order = tuple(c for c in ("doc_id",) if c in docs.columns) if order is None else order
    by = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)), F.lit(0).alias("z"))
    texts = docs.where(F.col(text).isNotNull()).select(by.alias("__by"), _name(text, half).alias("__tie"), F.col(text).alias("__text"))
    sets = _sets(texts, floor, _ranks(texts), half)
    buckets = max(1024, sets.count() * 12 >> 16)  # so that what meets in one is some 65,000 lookups, whatever the input
    kept = _kept(sets, texts, floor, (COMMON, LONG, LEADERS, buckets), copies, half)
    drop_written(sets)
    return _cut(docs, text, by, kept, _clashes(texts), floor, counts, copies, half)


def _name(text: str, half: int):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - half) if half < 64 else F.xxhash64(text)


def _clashes(texts: DataFrame) -> DataFrame:
    """The names that several texts have, written."""
    again = F.xxhash64(F.lit(1), "__text")
    return written(texts.groupBy(F.col("__tie").alias("clash")).agg(F.min(again).alias("a"), F.max(again).alias("b")).where("a <> b").select("clash"), "clashes")


def _cut(docs: DataFrame, text: str, by, kept: DataFrame, clashes: DataFrame, floor: int, counts: tuple[str, str], copies: bool = False, half: int = 64) -> DataFrame:
    """The rows of ``docs`` without the lines that the masks of their texts leave out, but for texts whose names clash; of rows equal in order and text, all but the
    first have their blank lines only, unless ``copies``."""
    names = [c for c in docs.columns if c not in counts]
    rest = F.struct(F.lit(0).alias("__0"), *(f"`{n}`" for n in names if n != text))
    by = by if copies else by.cast(kept.schema["by"].dataType)  # as it was read back, or the join would deal the texts by a cast of it and the window once more
    rows = docs.select(rest.alias("rest"), by.alias("by"), _name(text, half).alias("tie"), F.col(text).alias("t"))
    few = F.broadcast(clashes) if clashes.count() <= BROADCAST_ROWS else clashes
    rows = rows.join(few, F.col("tie") == F.col("clash"), "left")
    if copies:
        both, mask = rows.join(kept.select(F.col("tie").alias("tie2"), "mask"), F.col("tie") == F.col("tie2"), "left"), F.coalesce("mask", F.lit(b""))
    else:
        lists = kept.select(F.col("by").alias("by2"), F.col("tie").alias("tie2"), "mask", "n")
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        both = rows.join(lists, (F.col("tie") == F.col("tie2")) & (F.col("by") == F.col("by2")), "left").withColumn("first", F.col("row") == F.min("row").over(Window.partitionBy("tie", "by")))
        mask = F.when(F.col("first"), F.coalesce("mask", F.lit(b""))).otherwise(F.lit(b""))
    if floor <= 1:
        small = lambda x: F.trim(x, F.lit(_BLANK)) == ""
    else:
        small = lambda x: F.size(F.array_distinct(F.array_remove(F.split(F.translate(x, _UPPER, _UPPER.lower()), f"[{_BLANK}]+"), ""))) < floor
    cut = both.withColumn("mask", mask).withColumn("parts", F.split("t", "\n")).withColumn("left", F.filter("parts", lambda x, i: F.col("clash").isNotNull() | (F.substring("mask", i + 1, F.lit(1)) == F.lit(b"\1")) | small(x)))
    out = [F.array_join("left", "\n").alias(n) if n == text else F.col(f"rest.`{n}`").alias(n) for n in names]
    n_lines = F.coalesce(F.size("parts"), F.lit(0)).cast("long")
    lines = F.when(F.col("t").isNull(), 0).otherwise(n_lines).cast("long")
    left = F.when(F.col("t").isNull(), 0).otherwise(F.size("left")).cast("long")
    return cut.select(*out, lines.alias(counts[0]), (lines - left).alias(counts[1]))

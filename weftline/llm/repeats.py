"""Removal of repeated byte strings by common-prefix interval trees over anchored suffixes.

A suffix array of all bytes would be many times the input.  Instead every string of ``LENGTH`` bytes is given to an anchor
inside it that depends on its bytes alone, so equal strings meet under one anchor hash.  Only anchors whose hash comes up
twice are looked at, with just the bytes of the strings that they own (their context); equal contexts are counted, not
repeated.  For the contexts of one hash the sorted right sides form an enhanced suffix array, whose interval tree gives the
groups of repeats with all their members (:func:`weftline.llm.repeats_kernel.covers`).

A hash with many different contexts is split again, exactly: its strings are dealt by where the anchor lies in them, in
steps of ``WIDTHS`` bytes, and by the bytes that all strings of such a step have in common, until groups are small or single
strings remain, which need a count only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_written, written
from weftline.llm.repeats_kernel import LENGTH, anchors, covers, repeat_groups

#: different contexts of one key that go through one tree; keys with more are split
GROUP = 128
WIDTHS = (40, 5, 1)


def _id(raw: bytes, left: int) -> bytes:
    return hashlib.blake2b(raw, digest_size=16, salt=left.to_bytes(4, "little")).digest()


def _stored(docs: DataFrame, key: str, text: str) -> DataFrame:
    def pack(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zip_.compress(x) for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["key", "z", "n_bytes"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(pack, f"key {kind}, z binary, n_bytes long")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "bytes")


def _anchors(base: DataFrame, length: int) -> DataFrame:
    def find(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows, parts = [], []
                for row, z in zip(b.column(0).slice(at, 200).to_pylist(), b.column(1).slice(at, 200).to_pylist()):
                    parts.append(np.stack(anchors(unzip.decompress(z), length)))
                    rows.append(np.full(parts[-1].shape[1], row))
                h, p, left, right = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(h), "row": pa.array(np.concatenate(rows)), "place": pa.array(p), "l": pa.array(left.astype(np.int32)), "r": pa.array(right.astype(np.int32))})

    return written(base.where(F.col("n_bytes") >= length).select("row", "z").mapInArrow(find, "hash long, row long, place long, l int, r int"), "anchors")


def _contexts(base: DataFrame, shared: DataFrame) -> DataFrame:
    """A row for each anchor in ``shared``: hash, cid, row, place, l and ctx."""

    def cut(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                raw, row, found = unzip.decompress(b.column(1)[i].as_py()), b.column(0)[i].as_py(), b.column(2).slice(i, 1).flatten()
                h, p, left, right = (found.field(k).to_numpy() for k in range(4))
                for at in range(0, len(h), 5000):
                    s = slice(at, at + 5000)
                    ctx = [raw[x - y : x + z] for x, y, z in zip(p[s].tolist(), left[s].tolist(), right[s].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "hash": pa.array(h[s]), "cid": pa.array([_id(c, y) for c, y in zip(ctx, left[s].tolist())], pa.binary()), "row": pa.array(np.full(len(ctx), row, np.int64)),
                        "place": pa.array(p[s]), "l": pa.array(left[s]), "ctx": pa.array(ctx, pa.binary()),
                    })

    lists = shared.groupBy(F.col("row").alias("r2")).agg(F.collect_list(F.struct("hash", "place", "l", "r")).alias("found"))
    both = base.where("n_bytes > 0").select("row", "z").join(lists, F.col("row") == F.col("r2")).select("row", "z", "found")
    return both.mapInArrow(cut, "hash long, cid binary, row long, place long, l int, ctx binary")


def _trees(small: DataFrame, length: int, groups: bool = False) -> DataFrame:
    """(hash, cid, left, right) of contexts that lie in a repeat, or with ``groups`` of each group that they are in; rows of one hash
    come together, hash by hash."""

    def finish(group):
        sides = [c[left:] for _, _, left, c in group], [c[:left][::-1] for _, _, left, c in group]
        if groups:
            yield from ((cid, left, len(ctx) - left) for cid, n, left, ctx in group if n > 1)
            yield from ((group[m][0], a, b) for a, b, members in repeat_groups(*sides, length) for m in members)
            return
        for (cid, n, left, ctx), (a, b) in zip(group, covers(*sides, length) if len(group) > 1 else [(0, 0)]):
            if n > 1:
                yield cid, left, len(ctx) - left
            elif a + b >= length:
                yield cid, a, b

    def run(batches):
        key, group, out = None, [], ([], [], [], [])

        def close():
            for found in finish(group):
                for column, v in zip(out, (key, *found)):
                    column.append(v)

        def made():
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["hash", "cid", "left", "right"])

        for b in batches:
            for h, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if h != key:
                    if group:
                        close()
                    key, group = h, []
                group.append(rest)
            if len(out[0]) > 20_000:
                yield made()
                out = ([], [], [], [])
        if group:
            close()
        yield made()

    return small.select("hash", "cid", "n", "l", "ctx").repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "hash long, cid binary, left int, right int")


def _split(large: DataFrame, width: int, length: int) -> DataFrame:
    """The parts of each context for runs of ``width`` places of the anchor: hash2, cid2, n, l, ctx, and hash, cid (whole)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = tuple([] for _ in range(7))
                for h, cid, n, left, ctx in zip(*(c.slice(at, 200).to_pylist() for c in b.columns)):
                    low = length - (len(ctx) - left)
                    for t in range(low // width, left // width + 1):
                        a0, a1 = max(low, t * width), min(left, t * width + width - 1)
                        core = ctx[left - t * width : left + length - t * width - width + 1]
                        part = ctx[left - a1 : left + length - a0]
                        name = xxhash.xxh64_intdigest(core, seed=(h ^ (t * 64 + width)) & 0xFFFFFFFFFFFFFFFF)
                        for column, v in zip(out, (name - (name >> 63 << 64), _id(part, a1), n, a1, part, h, cid)):
                            column.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["hash2", "cid2", "n", "l", "ctx", "hash", "cid"])

    return large.select("hash", "cid", "n", "l", "ctx").mapInArrow(run, "hash2 long, cid2 binary, n long, l int, ctx binary, hash long, cid binary")


def _covered(different: DataFrame, length: int, level: int = 0, groups: bool = False) -> DataFrame:
    """(hash, cid, left, right) for ``different`` contexts (hash, cid, n, l, ctx): the widest span of each that is repeated, or with
    ``groups`` those of all groups."""
    spark = different.sparkSession
    many = different.groupBy(F.col("hash").alias("h2")).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > GROUP)
    if level == len(WIDTHS) or (many := written(many, "many")).isEmpty():
        if level == len(WIDTHS):  # single strings: a count says all
            return different.where("n > 1").select("hash", "cid", F.col("l").alias("left"), (F.lit(length) - F.col("l")).alias("right"))
        return _trees(different, length, groups)
    done = _trees(different.join(many, F.col("hash") == F.col("h2"), "left_anti"), length, groups)
    parts = written(_split(different.join(many, F.col("hash") == F.col("h2"), "left_semi"), WIDTHS[level], length), "parts")
    each = written(parts.groupBy(F.col("hash2").alias("hash"), F.col("cid2").alias("cid")).agg(F.sum("n").alias("n"), F.first("l").alias("l"), F.first("ctx").alias("ctx")), "each")
    under = _covered(each, length, level + 1, groups).select(F.col("hash").alias("h3"), F.col("cid").alias("c3"), "left", "right")
    up = parts.select("hash", "cid", "hash2", "cid2").join(under, (F.col("hash2") == F.col("h3")) & (F.col("cid2") == F.col("c3")))
    if groups:
        up = up.select("hash", "cid", "left", "right").distinct()
    else:
        up = up.groupBy("hash", "cid").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return done.unionByName(up.select("hash", "cid", F.col("left").cast("int"), F.col("right").cast("int")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch make one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _met(docs: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored texts, contexts of anchors that come up twice, the different ones of those)."""
    base = _stored(docs, key, text)
    every = _anchors(base, length)
    twice = every.groupBy(F.col("hash").alias("h2")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h2")
    twice = written(twice, "twice")  # a join with the counts themselves keeps all rows of a hash in one task; skew handling can split this one
    shared = every.join(twice, F.col("hash") == F.col("h2"), "left_semi")
    contexts = written(_contexts(base, shared), "contexts")
    drop_written(every)
    drop_written(twice)
    different = contexts.groupBy("hash", "cid").agg(F.count(F.lit(1)).alias("n"), F.first("l").alias("l"), F.first("ctx").alias("ctx"))
    return base, contexts, written(different, "different")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(group, length, ``key``, start): all occurrences of each maximal repeated string of ``length`` bytes or more that one anchor sees;
    group names the string.

    A longer repeat is told by its anchors, in strings that lie over one another.  Null texts count as empty, repeated rows as
    two occurrences each.  An empty table gives no rows."""
    base, contexts, different = _met(docs, key, text, length)
    found = _covered(different, length, groups=True).distinct().select(F.col("hash").alias("h3"), F.col("cid").alias("c3"), "left", "right")
    hit = contexts.join(found, (F.col("hash") == F.col("h3")) & (F.col("cid") == F.col("c3")))
    string = F.substring("ctx", F.col("l") - F.col("left") + 1, F.col("left") + F.col("right"))
    rows = hit.select(F.sha2(string, 256).alias("group"), (F.col("left") + F.col("right")).cast("long").alias("length"), "row", (F.col("place") - F.col("left")).alias("start")).distinct()
    return rows.join(base.select(F.col("row").alias("r4"), F.col("key").alias("__key")), F.col("row") == F.col("r4")).select("group", "length", F.col("__key").alias(key), "start")


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each row of ``docs``: ``key``, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay) and
    kept_sha256.

    A byte goes if a string of ``length`` bytes over it starts anywhere else too, in the same or another row; rows are judged
    on the input.  Null texts count as empty; texts below ``length`` bytes stay whole; repeated rows take each other's bytes
    away, like any copies.  ``kept`` may part a character of several bytes.  An empty table gives no rows."""
    base, contexts, different = _met(docs, key, text, length)
    found = written(_covered(different, length), "covered").select(F.col("hash").alias("h3"), F.col("cid").alias("c3"), "left", "right")
    hit = contexts.select("hash", "cid", "row", "place").join(found, (F.col("hash") == F.col("h3")) & (F.col("cid") == F.col("c3")))
    spans = hit.groupBy(F.col("row").alias("r3")).agg(F.collect_list(F.struct((F.col("place") - F.col("left")).alias("a"), (F.col("place") + F.col("right")).alias("b"))).alias("spans"))

    def take(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                removed, runs, kept, sha = [], [], [], []
                for z, spans_ in zip(b.column(2).slice(at, 500).to_pylist(), b.column(3).slice(at, 500).to_pylist()):
                    raw, cuts = unzip.decompress(z), merged([(x["a"], x["b"]) for x in spans_ or ()])
                    stay = b"".join(raw[a:c] for a, c in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(raw)]))
                    removed.append(len(raw) - len(stay))
                    runs.append(len(cuts))
                    kept.append(stay)
                    sha.append(hashlib.sha256(stay).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), b.column(1).slice(at, 500), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)], names=[key, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    final = base.join(spans, F.col("row") == F.col("r3"), "left").select(F.col("key"), "n_bytes", "z", "spans")
    return final.mapInArrow(take, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")

"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has a bit set where over half of a text's shingle hashes have it set.  Distinct fingerprints are dealt out by
the distance to vantage points, one for each level: those within the level's radius go left, the others right, and those on
the left that lie so near the boundary that a partner may be on the right go there as well.  So each pair of near
fingerprints meets in one shard at least, whatever the number of levels, and the number of levels grows with the logarithm
of the number of fingerprints.  Inside a shard the search goes on with a vantage-point tree of its own, and only edges of
spanning trees leave it.  Components are then joined up across shards by label propagation with pointer jumping.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_written, written

SEED = 42
SHINGLE = 3
RADIUS = 2
#: fingerprints from which vantage points and radii are taken
TREE_SAMPLE = 4096
#: fingerprints in a shard, as planned for
SHARD = 3000
_BLOCK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 bytes, 0 for None and texts without words."""
    words = raw.lower().split() if raw else []  # bytes: lower-cases A-Z only, parts at ASCII white space only
    if not words:
        return 0
    total, ones = 0, np.zeros(64, np.int64)
    count = max(1, len(words) - shingle + 1)
    for at in range(0, count, _BLOCK):
        part = words[at : at + _BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        total += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keep_columns: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep_columns`` and ``fp`` (long, the fingerprint's bits)."""
    order = [f for f in docs.schema if f.name in keep_columns and f.name != "fp"]
    names = [f.name for f in order]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), "fp long"])

    def run(batches):
        for b in batches:
            raw = b.column(len(names)).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in raw], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(fp)], names=[*names, "fp"])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(run, schema)


def route(fps: np.ndarray, vantage: np.ndarray, radius: np.ndarray, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(shard, fingerprint) rows: every pair within ``reach`` shares a shard."""
    shard = np.zeros(len(fps), np.int64)
    for v, r in zip(vantage, radius):
        d = np.bitwise_count(fps ^ v).astype(np.int64)
        near, both = d <= r, (d <= r) & (d > r - reach)
        # names of shards stay within 62 bits at any depth; a clash only puts two shards together
        left, right = shard * 2 & 0x3FFFFFFFFFFFFFFF, (shard * 2 + 1) & 0x3FFFFFFFFFFFFFFF
        shard = np.concatenate([np.where(near, left, right), right[both]])
        fps = np.concatenate([fps, fps[both]])
    return shard, fps


def near_pairs(fps: np.ndarray, reach: int = RADIUS) -> list[tuple[int, int]]:
    """Edges between positions that span the components of "at most ``reach`` bits apart" within ``fps`` (distinct)."""
    edges: list[tuple[int, int]] = []
    rng = np.random.default_rng(7)
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        if len(at) > 400:
            for _ in range(4):
                d = np.bitwise_count(fps[at] ^ fps[at[rng.integers(len(at))]]).astype(np.int64)
                r = int(np.median(d))
                right = d > r - reach
                if right.sum() < 0.95 * len(at) and (d <= r).sum() < 0.95 * len(at):
                    todo += [at[d <= r], at[right]]
                    break
            else:
                edges += _spanning(fps, at, reach)
            continue
        edges += _spanning(fps, at, reach)
    return edges


def _spanning(fps: np.ndarray, at: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """All of ``at`` against all, in blocks, until the smallest label of each component has reached all of it."""
    own, label = fps[at], np.arange(len(at))
    changed = True
    while changed:
        changed = False
        for i in range(0, len(at), 256):
            low = np.minimum.reduce([np.where(np.bitwise_count(own[i : i + 256, None] ^ own[None, j : j + 4096]) <= reach, label[None, j : j + 4096], len(at)).min(axis=1) for j in range(0, len(at), 4096)])
            if (low < label[i : i + 256]).any():
                label[i : i + 256], changed = low, len(at) > 1
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(at)))
    return list(zip(at[label[moved]].tolist(), at[moved].tolist()))


def shard_edges(fps: np.ndarray, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of the components within one shard."""
    fps = np.unique(fps)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in near_pairs(fps, reach):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ends = [(find(i), i) for i in range(len(fps))]
    ends = [x for x in ends if x[0] != x[1]]
    return fps[[a for a, _ in ends]], fps[[b for _, b in ends]]


def edges(distinct: DataFrame, reach: int = RADIUS) -> DataFrame:
    """(a, b) long: edges that span the components of all fingerprints in ``distinct`` (column ``fp``, no repeats)."""
    n = distinct.count()
    levels = max(0, math.ceil(math.log(max(1, n / SHARD)) / -math.log(0.62)))
    rate = min(1.0, TREE_SAMPLE / max(1, n))
    sample = np.array([r.fp for r in distinct.where(F.shiftrightunsigned(F.xxhash64("fp"), 11) <= int(rate * (1 << 53))).limit(2 * TREE_SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    sample.sort()
    rng = np.random.default_rng(n)
    vantage = sample[rng.permutation(len(sample))[:levels]] if len(sample) >= levels else rng.integers(0, 1 << 63, levels, dtype=np.uint64)
    radius = [int(np.median(np.bitwise_count(sample ^ v))) if len(sample) else 32 for v in vantage]

    def deal(batches):
        for b in batches:
            shard, fps = route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), vantage, radius, reach)
            for i in range(0, len(fps), 1 << 17):
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard[i : i + (1 << 17)]), "fp": pa.array(fps[i : i + (1 << 17)].view(np.int64))})

    def search(t: pa.Table) -> pa.Table:
        a, b = shard_edges(t.column("fp").to_numpy().view(np.uint64), reach)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return distinct.select("fp").mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInArrow(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``links`` (a, b long); root is the smallest node of the component."""
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), "labels")
    while True:
        of = label.select(F.col("node").alias("n"), F.col("root").alias("r"))
        met = both.join(of, F.col("b") == F.col("n")).groupBy(F.col("a").alias("node2")).agg(F.min("r").alias("low"))
        hook = written(label.join(met, F.col("node") == F.col("node2"), "left").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root")), "labels")
        jump = hook.select(F.col("node").alias("n"), F.col("root").alias("r"))
        new = written(hook.join(jump, F.col("root") == F.col("n"), "left").select("node", F.least("root", "r").alias("root"), (F.col("old") != F.least("root", "r")).alias("moved")), "labels")
        drop_written(label)
        drop_written(hook)
        label = new
        if label.where("moved").isEmpty():
            drop_written(both)
            return label.select("node", "root")


def cluster(prints: DataFrame, key: str = "doc_id", reach: int = RADIUS) -> DataFrame:
    """``prints`` (``key``, ``fp``) with ``component_id``: the smallest key whose fingerprint can be reached.

    Equal fingerprints are linked, those of texts without words included.  Null keys count for nothing in the smallest key
    (a component of null keys only has a null id).  Repeated rows come back as often.  Only distinct fingerprints take part
    in the search, so copies cost nothing; an empty table gives no rows."""
    least = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    found = components(edges(least.select("fp"), reach))
    named = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    low = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("of"), "component_id")
    named = written(named.join(low, F.col("root") == F.col("of")).select(F.col("fp").alias("own"), "component_id"), "components")
    return prints.join(named, F.col("fp") == F.col("own")).drop("own")

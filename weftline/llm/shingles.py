"""Near duplicates by SimHash, and the exact Jaccard similarity of shingle sets.

A text is the set of its runs of ``SHINGLE`` words.  The SimHashes of the sets go through the vantage-point search of
:mod:`weftline.llm.simhash`, which joins most copies at small cost; each of its links is verified on the sets.  Two sets at
the threshold differ by some ten bits of sixty-four, where no triangle bound prunes anything, so the rest is an exact join:
shingles are ordered by rarity, and two sets of similarity ``SIMILAR`` share one among the first few of both (prefix filter).
First each set is held against one other of each shingle; then all pairs that meet and are not joined yet, and that pass the
length and positional filters, are verified on the full sets.  No filter drops a similar pair, so the groups are those of
all pairs.

A shingle of which a large part of all sets may hold on is dealt to ``PARTS`` for the first step, whose own first sets are
held against each other.  In the second, a shingle that still has over ``COMMON`` sets is looked up in pairs with the next ones of a
prefix longer by one: two sets whose first shingle in common it is share another there.  Keys with more sets than that are cut
into cells of two parts each, so no key is one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import linesets as L
from weftline.llm.common import dealt_join, drop_written, released, written
from weftline.llm.linesets import prefix_of
from weftline.llm.simhash import RADIUS, components, edges

SHINGLE = 5
SIMILAR = (4, 5)  # 0.8, as a fraction; that of :func:`weftline.llm.linesets.prefix_of`
#: counts by which shingles are ordered; any order is right
BUCKETS = 1 << 16
_BUCKET = np.uint64(L.WORD_BITS - 16)
#: texts that are turned into Python's objects at once; rows of two longs that may be broadcast (16 MB), more are joined by a shuffle
_ROWS, BROADCAST_ROWS = 256, 1_000_000
#: bytes of a shingle in a packed set
WIDTH = 7
#: shingles of buckets with more than this share of all are dealt to so many parts; there are HOT such buckets at most
HOT, PARTS = 1024, 64
#: sets of a key, not joined yet, that are held against each other in one task, at most
COMMON = 4096
#: sets of so many shingles are not looked up in pairs, which grow with the square of a set; those below 5/4 of it as all others too
LONG = 320


def shingles(b: pa.RecordBatch, column: int):
    """(rows of the batch, :class:`weftline.llm.linesets.Sets`) of its texts with words."""
    for at in range(0, b.num_rows, _ROWS):
        for s in L.shingle_sets(b.column(column).slice(at, _ROWS).cast(pa.binary()).to_pylist(), SHINGLE):
            yield s.text + at, s


def fingerprints(s: L.Sets) -> np.ndarray:
    """The SimHash of each set: a bit is set where over half of the shingles' hashes have it set."""
    if not len(s.n):
        return np.zeros(0, np.int64)
    h, ones = L.mix(s.words, 11), np.zeros((len(s.n), 64), np.uint8)
    for bit in range(64):  # plane by plane: a long text takes a few bytes a shingle
        ones[:, bit] = 2 * np.add.reduceat((h >> np.uint64(63 - bit) & np.uint64(1)).astype(np.int32), s.start) > s.n
    return np.packbits(ones, axis=1).reshape(-1).view(np.int64)


def _survey(base: DataFrame, half: int) -> DataFrame:
    """(row, id, id2, fp) of each text and, with null row, counts of shingles by bucket (id, n); id 0 has no words."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids, ids2, fps = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for at, s in shingles(b, 1):
                ids[at], ids2[at] = s.ids(half)
                fps[at] = fingerprints(s)
                counts += np.bincount((s.words >> _BUCKET).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids), pa.array(ids2), pa.array(fps), pa.nulls(len(ids), pa.int64())], names=["row", "id", "id2", "fp", "n"])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([none := pa.nulls(len(some), pa.int64()), pa.array(some), none, none, pa.array(counts[some])], names=["row", "id", "id2", "fp", "n"])

    return written(base.mapInArrow(released(run), "row long, id long, id2 long, fp long, n long"), "shingles")


def _postings(base: DataFrame, rarity: np.ndarray, half: int) -> DataFrame:
    """(key, part, id, n, pos): the prefix of each set and one more, once per partition; part -1 where the shingle is not dealt.  Sets of
    fewer than five are similar to equal ones only."""
    sent, total = base.sparkSession.sparkContext.broadcast(rarity), int(rarity.sum())

    def run(batches):
        count, done = sent.value, set()
        for b in batches:
            for _, s in shingles(b, 1):
                ids = s.ids(half)[0]
                new = np.array([n >= 5 and not (i in done or done.add(i)) for i, n in zip(ids.tolist(), s.n.tolist())], bool)
                s, ids = s.only(new), ids[new]
                of = np.repeat(np.arange(len(s.n)), s.n)
                order = np.lexsort((s.words, count[(s.words >> _BUCKET).astype(np.int64) & (BUCKETS - 1)], of))
                pos = np.arange(len(of)) - s.start[of]
                use = pos <= prefix_of(s.n)[of]
                of, key, pos = of[use], s.words[order][use], pos[use].astype(np.int32)
                hot = count[(key >> _BUCKET).astype(np.int64) & (BUCKETS - 1)] * HOT > total
                key, part = key.view(np.int64), np.where(hot, ids[of] % PARTS, -1).astype(np.int32)
                for k in range(0, len(of), 1 << 16):
                    c = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[c]), pa.array(part[c]), pa.array(ids[of[c]]), pa.array(s.n[of[c]].astype(np.int32)), pa.array(pos[c])], names=["key", "part", "id", "n", "pos"])

    return base.mapInArrow(released(run), "key long, part int, id long, n int, pos int")


def _able(n1, p1, n2, p2):
    """The length filter, and the positional one; a pair that is similar passes at the first shingle of both."""
    up, down = SIMILAR
    return (F.least(n1, n2) * down >= F.greatest(n1, n2) * up) & (F.least(n1 - p1, n2 - p2) * (up + down) >= (n1 + n2) * up)


def _star(met: DataFrame) -> DataFrame:
    """(a, b): each set and the first of its shingle's part, and the first sets of parts and that of the shingle."""
    pair = lambda low, x: (F.col(f"{x}.id") > F.col(f"{low}.id")) & _able(*(F.col(f"{k}.{c}") for k in (x, low) for c in ("n", "pos")))
    within = met.withColumn("x", F.struct("id", "n", "pos")).where(pair("low", "x"))
    firsts = met.where("part >= 0").groupBy("key", "part").agg(F.min("low").alias("x")).withColumn("first", F.min("x").over(Window.partitionBy("key")))
    across = firsts.where(pair("first", "x")).withColumnRenamed("first", "low")
    return within.select(F.col("low.id").alias("a"), F.col("x.id").alias("b")).union(across.select("low.id", "x.id"))


def _apart(labelled: DataFrame) -> DataFrame:
    """``labelled`` (key, id, n, pos, root; written) of shingles whose sets are not all joined, with ``sets``, their number, written."""
    keys = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("sets"))
    keys = written(keys.where("least < most").select("key", "sets"), "keys")
    if keys.count() <= BROADCAST_ROWS:
        found = labelled.join(F.broadcast(keys), "key")
    else:
        found = dealt_join(labelled, keys.withColumn("rows", F.col("sets")), ["key"], "rows")
    found = written(found, "apart")
    drop_written(keys)
    return found


def _open(apart: DataFrame) -> DataFrame:
    """(a, b): sets that meet under a key, are not joined, and pass the filters."""
    up, down = SIMILAR
    inside = F.col("pos") < F.col("n") - F.ceil(F.col("n") * up / F.lit(down)) + 1
    single = apart.where(inside & ((F.col("sets") <= COMMON) | (F.col("n") >= LONG))).select("key", "id", "n", "pos", "root")
    common = apart.where(inside & (F.col("sets") > COMMON) & (F.col("n") * up <= LONG * down)).select("key", "id", "n", "pos", "root")
    nexts = apart.select(F.col("id").alias("i"), F.col("key").alias("other"), F.col("pos").alias("after"))
    paired = common.join(nexts, (F.col("id") == F.col("i")) & (F.col("after") > F.col("pos"))).select(F.xxhash64("key", "other").alias("key"), "id", "n", "pos", "root")
    looked = rows = written(single.union(paired), "lookups")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > COMMON)
    large = written(large.select(F.col("key").alias("k"), F.ceil(F.col("c") / COMMON).cast("int").alias("parts")), "large")
    few = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    rows = rows.join(few, F.col("key") == F.col("k"), "left").drop("k").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    x = rows.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("parts") - 1))).drop("own", "parts")
    y = rows.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).drop("own", "parts")
    y = y.select(*(F.col(c).alias(f"{c}2") for c in y.columns))
    cell = (F.col("key") == F.col("key2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & ((F.col("i") < F.col("j")) | (F.col("id") < F.col("id2")))
    both = x.join(y, cell & (F.col("root") != F.col("root2")) & _able(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
    found = written(both.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct(), "open")
    drop_written(looked)
    drop_written(large)
    return found


def _verified(pairs: DataFrame, base: DataFrame, survey: DataFrame, half: int) -> DataFrame:
    """``pairs`` (a, b: set ids) whose sets are similar enough, written."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    rows = survey.where(F.col("row").isNotNull()).join(ids, F.col("id") == F.col("w"), "left_semi").groupBy("id").agg(F.min(F.struct("id2", "row")).alias("m"))
    rows = written(rows.select(F.col("m.row").alias("r")), "rows")

    def sets(batches):
        for b in batches:
            for _, s in shingles(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array(s.ids(half)[0]), L.binaries(L.packed(s.words, WIDTH), s.n * WIDTH)], names=["id", "words"])

    def judge(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ok = pa.array(L.similar(b.column(2).to_pylist(), b.column(3).to_pylist(), WIDTH))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    few = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    full = base.join(few, F.col("__row") == F.col("r"), "left_semi").select("text").mapInArrow(released(sets), "id long, words binary")
    one, two = (full.select(F.col("id").alias(f"{k}_"), F.col("words").alias(f"{k}w")) for k in "ab")
    both = pairs.join(one, F.col("a") == F.col("a_")).join(two, F.col("b") == F.col("b_")).select("a", "b", "aw", "bw")
    found = written(both.mapInArrow(released(judge), "a long, b long"), "similar")
    drop_written(pairs)
    drop_written(rows)
    return found


def _by_simhash(survey: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHashes are equal or linked by the vantage-point search."""
    named = survey.where(F.col("row").isNotNull() & (F.col("id") != 0)).select("id", "fp").distinct()
    least = written(named.groupBy("fp").agg(F.min("id").alias("low")), "fingerprints")
    equal = named.join(least.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where(F.col("low") < F.col("id")).select(F.col("low").alias("a"), F.col("id").alias("b"))
    x, y = (least.select(F.col("fp").alias(f"f{k}"), F.col("low").alias(k)) for k in "xy")
    near = edges(least.select("fp"), RADIUS).join(x, F.col("a") == F.col("fx")).join(y, F.col("b") == F.col("fy"))
    return equal.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def groups(docs: DataFrame, row: str, text: str = "text", half: int = 64) -> DataFrame:
    """(row, group) for each of ``docs``, whose ``row`` is a long of its own: rows are in one group if a chain of texts of Jaccard
    similarity 0.8 or more, by shingles of five words, leads from one to the other.

    Texts without words, null ones too, are one group.  An empty table gives no rows.

    Sets are looked up by 64 bits of their names; where several sets have the same, told by another 64, the one of the lowest name is looked
    up and each other is a group of its own and its copies: no document is taken for a copy of another set.  ``half``: bits that are
    used of the first half (fewer in tests, for clashes)."""
    base = docs.select(F.col(row).alias("__row"), F.col(text).alias("text"))
    survey = _survey(base, half)
    cells = survey.where(F.col("row").isNull()).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(BUCKETS, np.int64)
    rarity[cells.column("id").to_numpy()] = cells.column("n").to_numpy()
    part = Window.partitionBy("key", "part")
    post = _postings(base, rarity, half).withColumn("low", F.min(F.struct("id", "n", "pos")).over(part)).withColumn("high", F.max("id").over(part))
    met = written(post.where((F.col("low.id") < F.col("high")) | (F.col("part") >= 0)).drop("high").distinct(), "met")
    star = written(_star(met).union(_by_simhash(survey)).distinct(), "star")
    links = _verified(star, base, survey, half)
    joined = components(links)
    labelled = met.join(joined, F.col("id") == F.col("node"), "left").select("key", "id", "n", "pos", F.coalesce("root", "id").alias("root"))
    labelled = written(labelled, "labelled")
    drop_written(met)
    # shingles all of whose sets are joined by now have nothing left to tell
    apart = _apart(labelled)
    drop_written(labelled)
    open_ = _open(apart)
    drop_written(apart)
    more = _verified(open_.join(star, ["a", "b"], "left_anti"), base, survey, half)
    drop_written(open_)
    drop_written(star)
    named = survey.where(F.col("row").isNotNull()).join(components(links.union(more)), F.col("id") == F.col("node"), "left")
    clashes = survey.where(F.col("row").isNotNull()).groupBy(F.col("id").alias("c")).agg(F.min("id2").alias("low"), F.max("id2").alias("high")).where("low <> high").select("c", "low")
    clashes = written(clashes, "clashes")
    named = named.join(F.broadcast(clashes) if clashes.count() <= BROADCAST_ROWS else clashes, F.col("id") == F.col("c"), "left")
    return named.select("row", F.when(F.col("id2") != F.col("low"), F.xxhash64("id", "id2")).otherwise(F.coalesce("root", "id")).alias("group"))

"""Packing token sequences by matching large items.

Documents are tokenised, ended by id 0 and cut into pieces of the capacity at most.  A piece above a third of the capacity
shares a sequence with one other such piece at most: those are matched greedily, the largest first, each with the largest
partner that fits.  Smaller pieces fill the gaps, the largest first, each where it leaves the least room.

The plan is made from the number of pieces of each length alone (at most ``capacity`` numbers, whatever the corpus): groups of
sequences with equal contents are counted, not listed.  Each piece then finds its place from its length and its rank among
the pieces of that length, so nothing but those counts comes to the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import released, written

CAPACITY = 2048
#: rows (four longs) that may be broadcast: 32 MB at most
BROADCAST_ROWS = 1_000_000
END = b"\0\0\0\0"
_CACHE = 400_000

#: texts of these characters only are cut into the tokenizer's words here; all others go to the tokenizer whole
_PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ňŊ-ž]*")
#: fixed value: the tokenizer's own pattern, its classes written out for those characters
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\s0-9a-zª²³µ¹º¼-¾ß-öø-ſ]+")


class Words(dict):
    """Word -> its ids as little-endian bytes, kept within a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > _CACHE:
            self.clear()
        self[word] = found = self.whole(word)
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids of ``text`` (None: empty), then the end mark.

        The tokenizer never joins what its pattern parts, so the ids of a text are those of its words; texts with characters
        whose class or normal form may depend on more than themselves, or with a special token's string, go in whole."""
        if not text:
            return END
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self.whole(text) + END
        return b"".join(map(self.__getitem__, _PIECE.findall(text.lower()))) + END


_LOADED: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, keep_columns: list[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: ``keep_columns``, piece, start, length, ids_crc32, ids (binary), and part and nth (the piece's
    place among those of its length in its partition)."""
    order = [f for f in docs.schema if f.name in keep_columns]
    names = [f.name for f in order]
    made = ["piece", "start", "length", "ids_crc32", "ids", "part", "nth"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), "piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"])

    def run(batches):
        part, seen, known = TaskContext.get().partitionId(), {}, words(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 250):
                rows, out = [], {m: [] for m in made}
                for i, t in enumerate(b.column(len(names)).slice(at, 250).to_pylist()):
                    ids = known.ids(t)
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        raw = ids[s : s + 4 * capacity]
                        n = len(raw) // 4
                        nth = seen.get(n, 0)
                        seen[n] = nth + 1
                        rows.append(at + i)
                        for m, v in zip(made, (k, s // 4, n, zlib.crc32(raw), raw, part, nth)):
                            out[m].append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(len(names))), *(pa.array(out[m], k) for m, k in zip(made, kinds))], names=[*names, *made])

    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(released(run), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of sequences, [(length, pieces of it in each of them)])] for ``counts`` of pieces by length."""
    left = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    order: list[int] = []  # the gaps in use

    def put(gap: int, count: int, held: list[tuple[int, int]]) -> None:
        if count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((count, held))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:  # partners from the largest that fits
            if m <= min(n, capacity - n) and left[n] and left[m]:
                pairs = left[n] // 2 if m == n else min(left[n], left[m])
                left[n] -= pairs
                left[m] -= pairs
                put(capacity - n - m, pairs, [(n, 2)] if m == n else [(n, 1), (m, 1)])
        put(capacity - n, left[n], [(n, 1)])
        left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            at = bisect_left(order, n)
            gap = order[at] if at < len(order) else capacity
            each = gap // n
            if gap in gaps and at < len(order):
                free, held = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    del order[at]
            else:
                free, held = -(-todo // each), []
            full = min(free, todo // each)
            put(gap - each * n, full, [*held, (n, each)])
            todo -= full * each
            rest = min(todo, each) if free > full else 0
            if rest:
                put(gap - rest * n, 1, [*held, (n, rest)])
                todo -= rest
            spare = free - full - bool(rest)
            if held:
                put(gap, spare, held)
    return [x for gap in order for x in gaps[gap]]


class Places:
    """(length, rank) -> (sequence, offset), for arrays."""

    def __init__(self, groups: list[tuple[int, list[tuple[int, int]]]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for count, held in groups:
            offset = 0
            for n, each in held:
                rank = used.get(n, 0)
                rows.append((n << 44 | rank, rank, sequence, each, offset))
                used[n] = rank + each * count
                offset += n * each
            sequence += count
        self.key, self.rank, self.sequence, self.each, self.offset = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T

    def table(self) -> pa.Table:
        """The same as rows: the pieces of length ``__n`` and ranks from ``__low`` up to ``__high`` lie in sequences from ``__sequence`` on,
        ``__each`` of them in one, from ``__offset`` on."""
        n, end = self.key >> 44, np.full(len(self.key), np.iinfo(np.int64).max)
        end[:-1] = np.where(n[1:] == n[:-1], self.rank[1:], end[:-1])
        columns = {"__n": n, "__low": self.rank, "__high": end, "__sequence": self.sequence, "__each": self.each, "__offset": self.offset}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        nth = rank - self.rank[i]
        return self.sequence[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


def pack(docs: DataFrame, tokenizer: str, keep_columns: list[str], text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece with ``sequence_id`` and ``offset`` besides; ``with_ids`` keeps the ids (binary).

    Null and empty texts give one piece, the end mark.  Repeated rows are packed as often as they come.  An empty table gives
    no rows.  Columns in ``keep_columns`` must not have the names of the results."""
    made = pieces(docs, tokenizer, keep_columns, text, capacity)
    cut = written(made if with_ids else made.drop("ids"), "pieces")
    tally = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = Places(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = tally.select(F.col("length").alias("__l"), F.col("part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    # a row for each length and partition: broadcast while they are few, else both sides are shuffled
    starts = F.broadcast(starts) if tally.count() <= BROADCAST_ROWS else starts.hint("merge")
    ranked = cut.join(starts, (F.col("length") == F.col("__l")) & (F.col("part") == F.col("__p"))).withColumn("__rank", F.col("__before") + F.col("nth")).drop("__l", "__p", "__before", "part", "nth")

    # a row for each length in each group of equal sequences: thousands, whatever the corpus
    places = F.broadcast(docs.sparkSession.createDataFrame(sent.table()))
    held = (F.col("length") == F.col("__n")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high"))
    nth = F.col("__rank") - F.col("__low")
    sequence, offset = F.col("__sequence") + F.floor(nth / F.col("__each")), F.col("__offset") + F.pmod(nth, F.col("__each")) * F.col("length")
    return ranked.join(places, held).select(*(f"`{c}`" for c in ranked.columns if c != "__rank"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))

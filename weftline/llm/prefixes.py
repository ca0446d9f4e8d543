"""The trie of the prefixes that conversations share.

The turns of a conversation are digested one after the other, each digest over the last one and the turn, so that equal digests are equal
prefixes.  Every prefix is a row; rows of equal depth and digest are a node.  Sums over subtrees: a node's value belongs to its smallest
member, on whose path all its ancestors lie, so that the rows (node, ancestor) of one member are added up on its path before they are
dealt out to the ancestors, and a long conversation makes as many rows as it has turns, not as many as their square.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import dealt_join, written

#: digests are SHA-256; rows carry the first 128 bits, in two numbers
NODE = ["depth", "g1", "g2"]
#: bytes of a list of ids that are put together in one piece before it is digested
PIECE = 64 * 1024


def turn_digest(role: Column, text: Column) -> Column:
    """A digest of a turn, which stands for it from here on: texts are not moved."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conversation, depth, g1, g2, p1, p2, n_bytes, last): a row for each prefix of each conversation, the empty one, too, with its
    parent's digest, the bytes of its last text, and whether the conversation ends there.

    ``turns``: (part, conversation, place, digest, n_bytes, own); all rows of a conversation have one ``part``, by which they are dealt.  A conversation
    is there if it has a row that is its ``own``; a null digest is no turn.  Its rows pass through one task in order of place: each digest needs
    the last one."""
    ready = turns.repartition("part").sortWithinPartitions("part", "conversation", F.col("digest").isNotNull(), "place").select("conversation", "digest", "n_bytes", "own")

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for c, digest, size, own in zip(*(batch.column(k).to_pylist() for k in ("conversation", "digest", "n_bytes", "own"))):
                if now is None or c != now.conversation:
                    out += now.end() if now else []
                    now = _Path(c)
                out += now.put(digest, size, own)
            yield _batch(out)
        if now:
            yield _batch(now.end())

    def _batch(out):
        kinds = (*[pa.int64()] * 7, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) if out else [()] * 8, kinds)], ["conversation", *NODE, "p1", "p2", "n_bytes", "last"])

    return ready.mapInArrow(run, "conversation long, depth long, g1 long, g2 long, p1 long, p2 long, n_bytes long, last boolean")


class _Path:
    """A conversation's prefixes as its turns pass by; holds the last row only, as the next one tells whether it is the end."""

    def __init__(self, conversation: int):
        self.conversation, self.depth, self.there, self.waiting = conversation, 0, False, None
        self.digest = hashlib.sha256(b"").digest()
        self.held = (conversation, 0, *self._short(self.digest), None, None, 0)

    @staticmethod
    def _short(digest: bytes) -> tuple[int, int]:
        return struct.unpack(">qq", digest[:16])

    def put(self, digest, size, own):
        self.there |= own
        if digest is None:
            return
        if self.there:
            yield (*self.held, False)
        above = self._short(self.digest)
        self.digest, self.depth = hashlib.sha256(self.digest + digest).digest(), self.depth + 1
        self.held = (self.conversation, self.depth, *self._short(self.digest), *above, size)

    def end(self):
        return [(*self.held, True)] if self.there else []


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, g1, g2, ends_sha256) of the nodes at which conversations end: of their ids, ascending, with commas between.

    Ids are dealt by ranges of (node, id) and put together in pieces, so that a node where very many end is gathered by many tasks; the digest over
    the pieces of a node is one stream."""
    ids = paths.where("last").select(*NODE, "conversation").repartitionByRange(*NODE, "conversation").sortWithinPartitions(*NODE, "conversation")

    def pieces(batches):
        at, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for *node, c in zip(*(batch.column(k).to_pylist() for k in (*NODE, "conversation"))):
                if node != at or size > PIECE:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, first, ids, size = node, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(out)
        if ids:
            yield _batch([(*at, first, ",".join(ids))])

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) if out else [()] * 5, (*[pa.int64()] * 4, pa.string()))], [*NODE, "first", "ids"])

    def digests(batches):
        at, now = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
                if node != at:
                    if at is not None:
                        out.append((*at, now.hexdigest()))
                    at, now = node, hashlib.sha256(ids.encode())
                else:
                    now.update(b"," + ids.encode())
            yield _told(out)
        if at is not None:
            yield _told([(*at, now.hexdigest())])

    def _told(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) if out else [()] * 4, (*[pa.int64()] * 3, pa.string()))], [*NODE, "ends_sha256"])

    node = "depth long, g1 long, g2 long"
    whole = ids.mapInArrow(pieces, f"{node}, first long, ids string").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return whole.select(*NODE, "ids").mapInArrow(digests, f"{node}, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of :func:`prefixes` of ``turns``: (conversation, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``conversation`` is the smallest member, ``parent`` the parent's; n_leaves counts nodes without children in the subtree, the node included;
    saved_tokens adds up (members - 1) x bytes of the last text over it.  Without conversations there are no nodes."""
    paths = written(prefixes(turns), "paths")
    own = paths.groupBy(*NODE).agg(F.min("conversation").alias("conversation"), F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("size"), F.count_if("last").alias("ends"))
    own = own.select("conversation", "depth", ((F.col("n") - 1) * F.col("size")).alias("value"), (F.col("n") == F.col("ends")).cast("long").alias("leaf"), F.lit(1).cast("long").alias("node"))
    both = paths.select("conversation", *NODE, "p1", "p2", "last").unionByName(own, allowMissingColumns=True)
    path = Window.partitionBy("conversation").orderBy(F.col("depth").desc())
    below, next_one = path.rangeBetween(Window.unboundedPreceding, 0), path.rangeBetween(-1, -1)
    summed = both.select("conversation", *NODE, "p1", "p2", "last", F.sum("value").over(below).alias("value"), F.sum("leaf").over(below).alias("leaf"), F.max("node").over(next_one).alias("child")).where(F.col("g1").isNotNull())
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    nodes = written(summed.groupBy(*NODE).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conversation").alias("conversation"), F.count(F.lit(1)).alias("n_convs"), zero("child"), zero("leaf"), zero("value"), F.count_if("last").alias("ends")), "nodes")
    parents = nodes.where("child > 0").select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conversation").alias("parent"), F.col("child").alias("__rows"))
    found = dealt_join(nodes, written(parents, "parents"), ["depth", "p1", "p2"], "__rows", "left")
    found = found.join(_ends(paths), NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conversation", "depth", "parent", "n_convs", F.col("child").alias("n_children"), F.col("leaf").alias("n_leaves"), F.col("value").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: fixed values of the query: conversations go in families of five, whose first lends the others its first turns, eight at most
FAMILY, LENT = 5, 9


def rebuilt(rows: DataFrame, by_text: bool = False) -> DataFrame:
    """Turns for :func:`trie`, of rows (conv_id, turn, role, text) with long ids: conversation c begins with the first h turns of conversation c - c % 5
    in place of its own first h; h is crc32 of c modulo 9.

    Turns go by turn (nulls first), then by role and a digest of both, or ``by_text`` by role and text (nulls last), for which texts are moved once; null
    roles and texts are empty; rows without a conv_id are left out.  A family has one part: the lent turns are there already, and no row is dealt
    twice.  Null digests tell that a conversation is there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lent = lambda c: F.crc32(c.cast("string").cast("binary")) % LENT
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    ties = {"__role": F.col("role"), "__text": F.col("text")} if by_text else {"__role": role}
    said = rows.where("conv_id IS NOT NULL").select(base.alias("part"), "conv_id", "turn", *(c.alias(n) for n, c in ties.items()), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")).repartition("part")
    order = [F.col("turn").asc_nulls_first(), *(F.col(n).asc_nulls_last() for n in ties), F.col("digest")]
    placed = said.withColumn("place", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order)) - 1)
    is_base = F.col("conv_id") == F.col("part")
    near = F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda k: F.try_add(F.col("part"), k))  # null beyond the last id
    takers = F.filter(near, lambda c: (c != F.col("part")) & (c - c % FAMILY == F.col("part")) & (lent(c) > F.col("place")))
    keeps = is_base | (F.col("place") >= lent(F.col("conv_id")))
    goes = lambda c, own, turn: F.struct(c.alias("conversation"), F.lit(own).alias("own"), F.lit(turn).alias("turn"))
    some = lambda condition, found: F.when(condition, found).otherwise(F.slice(found, 1, 0))
    own = lambda turn: F.array(goes(F.col("conv_id"), True, turn))
    there = some(F.col("place") == 0, own(False))
    out = F.concat(there, some(keeps, own(True)), some(is_base & (F.col("place") < LENT), F.transform(takers, lambda c: goes(c, False, True))))
    turns = placed.select("part", F.explode(out).alias("__g"), "place", "digest", "n_bytes")
    is_turn = F.col("__g.turn")
    return turns.select("part", "__g.conversation", "place", F.when(is_turn, F.col("digest")).alias("digest"), F.when(is_turn, F.col("n_bytes")).otherwise(0).alias("n_bytes"), "__g.own")

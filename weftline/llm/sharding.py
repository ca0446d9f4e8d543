"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size.  The shards take turns; at its turn a
shard claims the first slot of its order that is still free, until the table is full.  A row is placed by hashing its key
to a slot and reading the slot's shard: constant time, even load, and few moves when a shard comes or goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: slots of the default table: a prime, over 100 times the default number of shards
TABLE_SIZE = 6451
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _digest(text: str) -> tuple[int, int]:
    raw = hashlib.md5(text.encode()).hexdigest()
    return int(raw[:8], 16), int(raw[8:16], 16)


def fill_table(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard for each slot.

    ``size`` must be a prime larger than the number of shards; names must be distinct.  The order of names does not matter
    for the placement, as turns are taken in sorted order."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be distinct and there must be one at least")
    if size <= len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime above the number of shards")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    start, step = zip(*(((a % size), b % (size - 1) + 1) for a, b in map(_digest, shards)))
    at, owner, left = list(start), [-1] * size, size
    while True:
        for shard in turns:
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            owner[at[shard]] = shard
            left -= 1
            if not left:
                return owner


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (string).

    The lookup table has ``size`` rows whatever the data, so it is always broadcast; rows are not shuffled, and a key that
    holds a third of all rows is no slower than any other.  A null key counts as the empty text.  Equal keys share a shard.
    Columns of ``df`` named ``slot`` or ``shard`` are replaced."""
    owner = fill_table(shards, size)
    lookup = df.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "slot long, shard string")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(size)
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    return df.withColumn("slot", slot).select(*rest, "slot").join(F.broadcast(lookup), "slot").select(*rest, "slot", "shard")

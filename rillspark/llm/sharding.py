"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by an offset and a step that are hashed from its name.
The shards take turns; at its turn, a shard claims the next free slot of its permutation. When all slots are taken, every shard
has nearly the same number, and taking a shard away moves few slots between the others. A row's key is hashed to a slot; the
table (SLOTS rows of two integers: a fixed size) is broadcast, so placing a row takes constant time and moves nothing.

Results for odd input: a null key hashes like the text "null"; equal keys share a shard; a key that holds a third of all rows gives
a large shard, unless `spread` deals each key over several slots by the row's hash; repeated rows are placed alike; columns of the names
slot and shard are replaced by the results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime; about 100 slots or more a shard keep the shards within a percent of each other.
SLOTS = 65_537


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@functools.lru_cache(maxsize=8)
def filled(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """For each slot, the place in `shards` of the shard that claimed it. The order of the names does not matter, but for numbering."""
    if not shards:
        raise ValueError("at least one shard is needed")
    if len(set(shards)) < len(shards):
        raise ValueError("names of shards must differ")
    turns = sorted(range(len(shards)), key=lambda k: shards[k])
    at = {k: _hash(f"offset {shards[k]}") % slots for k in turns}
    step = {k: _hash(f"step {shards[k]}") % (slots - 1) + 1 for k in turns}
    owner = [-1] * slots
    left = slots
    while left:
        for k in turns[: min(left, len(turns))]:
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + step[k]) % slots
            owner[slot] = k
            at[k] = (slot + step[k]) % slots
        left -= min(left, len(turns))
    return tuple(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sharded(rows: DataFrame, shards: tuple[str, ...], key: str = "doc_id", slots: int = SLOTS, spread: Column | None = None) -> DataFrame:
    """`rows` with slot and shard (a name). `spread` is a further key, for rows whose first key may be hot."""
    table = rows.sparkSession.createDataFrame(
        [(slot, shards[k]) for slot, k in enumerate(filled(shards, slots))],
        T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.StringType(), False)]),
    )
    name = F.col(key) if spread is None else F.concat_ws(" ", F.coalesce(F.col(key).cast("string"), F.lit("null")), spread.cast("string"))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    return rows.select(*kept, slot_of(name, slots).alias("slot")).join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def oracle(shards: tuple[str, ...], slots: int = SLOTS) -> str:
    """The same placement of documents in SQL, with the table as a literal."""
    names = ", ".join(f"'{s}'" for s in shards)
    owners = ", ".join(str(k + 1) for k in filled(shards, slots))
    return f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents),
t AS (SELECT [{owners}] AS owner, [{names}] AS name)
SELECT doc_id, slot, name[owner[slot + 1]] AS shard FROM d, t
"""

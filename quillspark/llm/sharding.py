"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots for its virtual nodes (at least eight for each); each shard owns several virtual nodes. Keys are
placed in ring order (slot, hash, key): a key goes to the first shard clockwise
from its slot that is not full, a shard being full at
ceil((1 + slack) * keys / shards). Which shard takes how many keys of a slot
depends only on the number of keys of each slot, a table whose size follows shards * vnodes and not the data, so the
driver settles it from counts. Of the few slots that are split between
shards, the different keys are counted and ranked, never their copies: rows of one key are alike, so they are
dealt out by number, and a key that a third of all rows have costs no more than another. The texts are never read.

Defined cases: a null key is a key like any other (all nulls share a slot), and so is one that is no whole number, which counts as null;
repeated keys count each time, and copies of a key may part only at a shard's
limit; ties in the hash go by key, nulls first; an empty table gives an empty result; other columns, very long texts among them, are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole

#: Slots of the smallest ring, in bits; and rows of one key that are dealt out together.
SLOT_BITS, DEALT = 16, 10_000


def slot_bits(shards: int, vnodes: int) -> int:
    return max(SLOT_BITS, math.ceil(math.log2(shards * vnodes)) + 3)


def ring(shards: int, vnodes: int) -> np.ndarray:
    """The owner of each slot: the shard of the first virtual node at or after it."""
    slots = 1 << slot_bits(shards, vnodes)
    owner = np.full(slots, -1, np.int64)
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest()) % slots
            while owner[at] >= 0:
                at = (at + 1) % slots
            owner[at] = s
    nodes = np.flatnonzero(owner >= 0)
    nearest = np.searchsorted(nodes, np.arange(slots))
    return owner[nodes[nearest % len(nodes)]]


def settle(counts: np.ndarray, owner: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(slot, first rank, last rank + 1, shard) for all keys, taking slots in ring order."""
    load: dict[int, int] = dict.fromkeys(np.unique(owner).tolist(), 0)
    change = np.flatnonzero(np.diff(np.r_[owner, owner[0]]))  # the last slot of each arc
    arcs = owner[(change + 1) % len(owner)]
    arc_of = np.searchsorted(change, np.arange(len(owner)))
    out = []
    for slot in np.flatnonzero(counts).tolist():
        left, rank, shard, arc = int(counts[slot]), 0, int(owner[slot]), int(arc_of[slot])
        while left:
            take = min(left, capacity - load[shard])
            if take:
                out.append((slot, rank, rank + take, shard))
                load[shard] += take
                rank, left = rank + take, left - take
            if left:
                shard, arc = int(arcs[arc % len(arcs)]), arc + 1
    return out


def shard(docs: DataFrame, shards: int = 64, vnodes: int = 128, slack: float = 0.1, key: str = "doc_id") -> DataFrame:
    """(doc_id, shard, home_shard, moved): home_shard is the ring's owner of the key's slot, moved tells whether the bound sent it on."""
    spark, bits = docs.sparkSession, slot_bits(shards, vnodes)
    keys = docs.select(whole(key).alias("doc_id")).select("doc_id", F.xxhash64("doc_id", F.lit("ring")).alias("h"))
    keys = keys.select("doc_id", "h", F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot"))
    found = keys.groupBy("slot").count().toArrow()  # at most as many rows as slots
    counts = np.zeros(1 << bits, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("count").to_numpy()
    owner = ring(shards, vnodes)
    capacity = math.ceil((1 + slack) * int(counts.sum()) / shards)
    rows = np.array(settle(counts, owner, capacity), np.int64).reshape(-1, 4)
    slot, home = rows[:, 0], owner[rows[:, 0]]
    uses = np.bincount(slot, minlength=1 << bits)[slot]
    table = pa.table({"slot": slot.astype(np.int32), "lo": rows[:, 1], "hi": rows[:, 2], "shard": rows[:, 3].astype(np.int32), "home_shard": home.astype(np.int32)})
    # both tables have at most as many rows as there are slots and shards, whatever the input
    one, more = (F.broadcast(spark.createDataFrame(table.filter(pa.array(x)))) for x in (uses == 1, uses > 1))
    out = F.col("shard"), F.col("home_shard"), (F.col("shard") != F.col("home_shard")).alias("moved")
    plain = keys.join(one, "slot").select("doc_id", *out)
    split = keys.join(F.broadcast(more.select("slot").distinct()), "slot", "left_semi").groupBy("slot", "h", "doc_id").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    split = split.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n")).join(more, "slot").where("from < hi and upto > lo")
    split = split.select("doc_id", "shard", "home_shard", (F.least("upto", "hi") - F.greatest("from", "lo")).alias("n"))
    dealt = split.withColumn("k", F.explode(F.expr(f"sequence(0, (n - 1) div {DEALT})"))).repartition("shard", "doc_id", "k")
    parted = dealt.select("doc_id", "shard", "home_shard", F.explode(F.expr(f"sequence(1, least({DEALT}, n - k * {DEALT}))")))
    return plain.unionAll(parted.select("doc_id", *out))

"""Best-fit-decreasing sharding of indivisible groups.

Groups enter, largest first, the shard with the least remaining capacity that
still holds them, found in a balanced search tree; one that fits nowhere goes
to the emptiest shard, or opens a further one if the number is not fixed.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_bytes

OVERHEAD = 16
GRAIN = 1024
BUCKETS = 1024


class CapacityTree:
    """Remaining capacities in order: a B-tree of two levels whose leaves are
    split at twice and dropped at zero keys, so every step is logarithmic."""

    LEAF = 64

    def __init__(self, keys: list[tuple[int, int]] = ()):
        keys = sorted(keys)
        self.leaves = [keys[i:i + self.LEAF] for i in range(0, len(keys), self.LEAF)] or [[]]

    def _leaf(self, key: tuple[int, int]) -> int:
        return min(bisect_left(self.leaves, key, key=lambda leaf: leaf[-1] if leaf else (-(1 << 62), 0)), len(self.leaves) - 1)

    def add(self, key: tuple[int, int]) -> None:
        k = self._leaf(key)
        insort(self.leaves[k], key)
        if len(self.leaves[k]) > 2 * self.LEAF:
            leaf = self.leaves[k]
            self.leaves[k:k + 1] = [leaf[:self.LEAF], leaf[self.LEAF:]]

    def pop_at_least(self, room: int) -> tuple[int, int] | None:
        k = self._leaf((room, -1))
        j = bisect_left(self.leaves[k], (room, -1))
        return self._pop(k, j) if j < len(self.leaves[k]) else None

    def pop_largest(self) -> tuple[int, int]:
        """Of equal capacities the one of the lowest shard."""
        room = self.leaves[-1][-1][0]
        got = self.pop_at_least(room)
        assert got
        return got

    def _pop(self, k: int, j: int) -> tuple[int, int]:
        key = self.leaves[k].pop(j)
        if not self.leaves[k] and len(self.leaves) > 1:
            del self.leaves[k]
        return key


def best_fit_decreasing(sizes: list[int], capacity: int, shards: int | None = None) -> list[int]:
    """Shard of each size; sizes are taken largest first, ties in the given order.
    With a fixed number of shards what fits nowhere goes to the emptiest one."""
    tree = CapacityTree([(capacity, s) for s in range(shards or 0)])
    made, out = shards or 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = tree.pop_at_least(sizes[i]) if made else None
        if got is None and shards is None:
            got, made = (capacity, made), made + 1
        elif got is None:
            got = tree.pop_largest()
        out[i] = got[1]
        tree.add((got[0] - sizes[i], got[1]))
    return out


def _place(capacity: int, shards: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("bucket", "ascending"), ("parcel", "ascending")])
        return pa.table({"bucket": t["bucket"], "parcel": t["parcel"], "shard": pa.array(best_fit_decreasing(t["bytes"].to_pylist(), capacity, shards), pa.int32())})
    return run


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40,
                    overhead: int = OVERHEAD, grain: int = GRAIN, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents of equal text stay together.  A group above 1/`grain` of a shard
    is an item of its own; smaller ones are first bundled, largest first, into
    parcels of about that size within `buckets` hash buckets.  There are thus
    at most 2 * shards * grain + buckets items, whatever the input, and
    best-fit decreasing runs over them in one small task; shard sizes differ by
    about a parcel.  A group larger than a shard's share cannot be split and
    makes its shard that much larger.

    A null text counts as empty and as equal to an empty one.  Repeated rows
    and ids keep a slot each; a null doc_id is kept.  An empty table gives an
    empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    t = text_bytes(text_col)
    rows = scratch.save(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(t) + overhead).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.md5(t)).alias("key")))
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    capacity = -(-total // shards)
    small = max(1, capacity // grain)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    spread = groups.withColumn("bucket", bucket)
    run = Window.partitionBy("bucket").orderBy(F.col("bytes").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    parcels = spread.where(F.col("bytes") < small).withColumn("parcel", F.floor(F.coalesce(F.sum("bytes").over(run), F.lit(0)) / small))
    alone = spread.where(F.col("bytes") >= small).withColumn("parcel", -1 - F.row_number().over(Window.partitionBy("bucket").orderBy("key")).cast("long"))
    placed = scratch.save(parcels.unionByName(alone))
    items = placed.groupBy("bucket", "parcel").agg(F.sum("bytes").alias("bytes"))
    home = items.groupBy(F.lit(0).alias("all")).applyInArrow(_place(capacity, shards), "bucket int, parcel long, shard int")
    # at most 2 * shards * grain + buckets rows of 16 bytes: about 1.5 MB
    of_group = placed.join(F.broadcast(home), ["bucket", "parcel"]).select("key", "shard")
    sharded = rows.join(of_group, "key")
    part = F.pmod(F.xxhash64("key", "doc_id"), F.lit(64)).cast("int")
    sharded = scratch.save(sharded.withColumn("part", part))
    counts = sharded.groupBy("shard", "part").agg(F.count("*").alias("c"))
    # 64 counts for each shard
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "part", "base")
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    return sharded.withColumn("nth", nth).join(F.broadcast(base), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

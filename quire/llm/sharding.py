"""Sharding by best-fit decreasing: groups of equal texts go whole into shards of one fixed capacity.

Law: bytes. Groups of at least 1/(shards * GRAIN) of all bytes are packed one by one - there are shards * GRAIN
of them at most. The rest hash into shards * GRAIN parcels, each of which is packed like a group. So the driver
packs at most twice that many items whatever the corpus holds, and shards come out within about 1/GRAIN of each
other unless a single group is larger than a shard's share; such a group stays whole and has its own shard, and
the other groups are levelled over the other shards. Their capacity is the least, to 1/GRAIN, at which they fit.

Equality of texts is that of their SHA-256. Defined results: a null text has size 16 and crc32 0 and groups
with empty texts. Repeated rows each take a slot. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, rank_offsets, stage, with_local_rank

SHARDS = 40
GRAIN = 500
OVERHEAD = 16


def best_fit(sizes: list[tuple[int, int]], capacity: int, shards: int) -> dict[int, int] | None:
    """(size, key) in descending order of size -> shard by key, or None if they do not fit. The sorted list of rooms is the balanced tree."""
    rooms = [(capacity, s) for s in range(shards)]
    placed = {}
    for size, key in sizes:
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            return None
        room, shard = rooms.pop(at)
        placed[key] = shard
        insort(rooms, (room - size, shard))
    return placed


def assign(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Items larger than the mean share of what is left get a shard each; the rest goes to the other shards with the least capacity found by bisection."""
    items = sorted(sizes, key=lambda x: (-x[0], x[1]))
    if not items:
        return {}
    total, own = sum(s for s, _ in items), {}
    while items[len(own)][0] * (shards - len(own)) > total:
        size, key = items[len(own)]
        own[key] = shards - 1 - len(own)
        total -= size
        if len(own) == len(items):
            return own
    items, shards = items[len(own) :], shards - len(own)
    low = high = -(-total // shards)
    while (placed := best_fit(items, high, shards)) is None:
        low, high = high + 1, high + max(1, high // 64)
    while high - low > max(0, total // shards // (4 * GRAIN)):
        middle = (low + high) // 2
        if (found := best_fit(items, middle, shards)) is None:
            low = middle + 1
        else:
            high, placed = middle, found
    return own | placed


def shard(docs: DataFrame, shards: int = SHARDS, grain: int = GRAIN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row."""
    spark, limit = docs.sparkSession, shards * grain
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    measured = docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.sha2(data, 256).alias("same"))
    measured = stage(measured.withColumn("parcel", F.pmod(F.xxhash64("same"), F.lit(limit))), "measured")
    groups = stage(measured.groupBy("same", "parcel").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = (F.col("bytes") * limit >= total) & (F.col("bytes") > 0)
    heavy = [(r["bytes"], r["same"]) for r in groups.where(large).collect()]  # `limit` rows at most: each holds 1/limit of the bytes
    light = [(r["bytes"], r["parcel"]) for r in groups.where(~large).groupBy("parcel").agg(F.sum("bytes").alias("bytes")).collect()]  # `limit` at most
    names = [name for _, name in sorted(heavy, key=lambda x: x[1])]
    number = {name: limit + i for i, name in enumerate(names)}
    placed = assign([*light, *((size, number[name]) for size, name in heavy)], shards)
    by_group = spark.createDataFrame([(name, placed[number[name]]) for name in names], "same string, own int")
    by_parcel = spark.createDataFrame([(int(p), placed[p]) for _, p in light], "parcel long, shared int")
    dealt = measured.join(F.broadcast(by_group), "same", "left").join(F.broadcast(by_parcel), "parcel", "left")
    dealt = dealt.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    ranked = stage(dealt.mapInArrow(with_local_rank("shard"), f"{kinds}, chunk int, local_rank long"), "ranked")
    base = broadcast_if_small(stage(rank_offsets(ranked, "shard"), "offsets"))
    return ranked.join(base, ["chunk", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("local_rank") + F.col("base")).alias("slot"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

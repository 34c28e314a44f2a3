"""Sharding by fixed virtual slots.

Every record is hashed into one of some thousands of virtual slots, which never change. Only the
versioned map from slots to shards does: bytes are summed per slot, and rebalancing edits the map.
The map has one row per slot, so its size is fixed and it may be broadcast and handled on the driver.

Records are hashed by their text, so that equal texts meet in one slot and shard. Only a group of copies that alone is larger than a
shard may be is hashed by its ids too, since sizes must stay near equal. Places in a slot are given in sub-slots, whose
number follows the slot's rows, so that a large group's rows are placed by many tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: the shard of each virtual slot."""

    version: int
    shards: int
    shard: tuple[int, ...]

    @staticmethod
    def even(weights: list[int], shards: int) -> SlotMap:
        """A first map: heaviest slot first, each to the lightest shard."""
        loads, to = [(0, s) for s in range(shards)], [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            load, s = heapq.heappop(loads)
            to[slot] = s
            heapq.heappush(loads, (load + weights[slot], s))
        return SlotMap(1, shards, tuple(to))

    def rebalance(self, weights: list[int], shards: int) -> SlotMap:
        """The next version for other weights or more shards: slots leave only shards above the mean, and
        those of dropped shards leave all; whatever leaves goes to the lightest shard."""
        mean = sum(weights) / shards
        loads, to, free = [0] * shards, list(self.shard), []
        for slot, s in enumerate(self.shard):
            if s >= shards:
                free.append(slot)
            else:
                loads[s] += weights[slot]
        for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            if to[slot] < shards and weights[slot] and loads[to[slot]] - weights[slot] >= mean:
                loads[to[slot]] -= weights[slot]
                free.append(slot)
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        for slot in sorted(free, key=lambda i: (-weights[i], i)):
            load, s = heapq.heappop(heap)
            to[slot] = s
            heapq.heappush(heap, (load + weights[slot], s))
        return SlotMap(self.version + 1, shards, tuple(to))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version below the path, in a folder of its own; a version written twice is replaced."""
        rows = [(self.shards, i, s) for i, s in enumerate(self.shard)]
        spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions stored below a path; none if there is no such folder."""
        from pyspark.errors import AnalysisException

        try:
            table = spark.read.option("basePath", path).schema(f"{_MAP}, version int").parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(r["version"] for r in table.select("version").distinct().collect())

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest unless one is named. It must have each slot once."""
        version = max(SlotMap.versions(spark, path)) if version is None else version
        rows = spark.read.schema(_MAP).parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
        if [r["virtual_slot"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"version {version} of the slot map is not whole")
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


_MAP = "shards int, virtual_slot int, shard int"


def with_slots(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, row (a number) and virtual_slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    own = common.stored(own)
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = own.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    hot = [r["digest"] for r in groups.filter((F.col("bytes") > total / shards) & (F.col("n") > 1)).select("digest").collect()]  # fewer than shards
    key = F.when(F.col("digest").isin(hot), common.hash_key("doc_id", "text_crc32")).otherwise(F.col("digest")) if hot else F.col("digest")
    return own.withColumn("virtual_slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).drop("digest")


def slot_weights(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot."""
    sizes, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["size"], r["n"]
    return sizes, rows


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Puts every row into one of the shards, whose sizes in bytes are near equal, and gives it a place
    there: ``slot`` runs from 0 without gaps in each shard, along virtual slots, their sub-slots and then ids.

    A null text has size 1. Equal texts, however long, share a virtual slot and shard unless they are more than a shard's mean together:
    such a group is dealt by id and checksum. Repeated rows take places of their own. The map's versions go to
    ``map_path`` (default: the shared folder); the newest one found there is edited rather than made anew.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, shards, slots)
    sizes, rows = slot_weights(slotted, slots)
    path = map_path or common.shared_dir(spark)
    now = SlotMap.load(spark, path).rebalance(sizes, shards) if map_path and SlotMap.versions(spark, path) else SlotMap.even(sizes, shards)
    now.save(spark, path)
    mean = max(1, -(-sum(rows) // slots))
    parts = {v: -(-n // (2 * mean)) for v, n in enumerate(rows) if n > 2 * mean}  # slots / 2 sub-slots at most, besides one each
    if parts:
        many = spark.createDataFrame(list(parts.items()), "virtual_slot int, parts int")
        slotted = slotted.join(F.broadcast(many), "virtual_slot", "left").withColumn("sub", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))
        counted = {(r["virtual_slot"], r["sub"]): r["n"] for r in slotted.filter("parts is not null").groupBy("virtual_slot", "sub").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        slotted, counted = slotted.withColumn("sub", F.lit(0)), {}
    filled, table = [0] * shards, []
    for v in range(slots):
        for sub in range(parts.get(v, 1)):
            table.append((v, sub, now.shard[v], filled[now.shard[v]], now.version))
            filled[now.shard[v]] += counted.get((v, sub), 0) if v in parts else rows[v]
    lookup = spark.createDataFrame(table, "virtual_slot int, sub int, shard int, base long, map_version int")
    order = Window.partitionBy("virtual_slot", "sub").orderBy("doc_id", "text_crc32", "size", "row")
    return (
        slotted.withColumn("place", F.row_number().over(order))
        .join(F.broadcast(lookup), ["virtual_slot", "sub"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
    )

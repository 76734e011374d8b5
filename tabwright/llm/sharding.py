"""Shards by fixed virtual slots: a record's hash names its slot, a map names the shard.

Records hash into ``SLOTS`` slots for ever. The bytes of each slot are summed over all
records, and a versioned slot-to-shard map is stored; rebalancing edits the map and moves
whole slots. The slot sizes (a table of ``SLOTS`` rows, whatever the input) are the only
thing the driver sees.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, new_shared_path

SLOTS = 16_384


@dataclass
class SlotMap:
    """``owner[slot]`` is the slot's shard; ``version`` counts the edits."""

    version: int
    shards: int
    owner: list[int]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, s, o) for s, o in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version beside the earlier ones."""
        self.table(spark).coalesce(1).write.parquet(f"{folder}/version={self.version:06d}")


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{folder}/version={version:06d}").orderBy("virtual_slot").collect()
    return SlotMap(version, rows[0]["shards"], [r["shard"] for r in rows])


def _by_size(sizes: list[int]) -> list[int]:
    return sorted(range(len(sizes)), key=lambda s: (-sizes[s], s))


def balanced_map(sizes: list[int], shards: int) -> SlotMap:
    """Largest slots first, each to the lightest shard (ties: the smaller shard)."""
    load = [(0, k) for k in range(shards)]
    owner = [0] * len(sizes)
    for s in _by_size(sizes):
        have, k = heapq.heappop(load)
        owner[s] = k
        heapq.heappush(load, (have + sizes[s], k))
    return SlotMap(1, shards, owner)


def rebalanced(current: SlotMap, sizes: list[int], shards: int) -> SlotMap:
    """The next version of a map for new sizes or another shard count.

    Slots move only from shards over their fair share (or past the last shard) to the
    lightest ones, so an added shard takes slots only into itself.
    """
    load = [0] * max(shards, current.shards)
    for s, k in enumerate(current.owner):
        load[k] += sizes[s]
    fair = sum(sizes) / shards
    owner = list(current.owner)
    moved = []
    for s in _by_size(sizes):
        k = owner[s]
        if k >= shards or load[k] - sizes[s] >= fair:
            load[k] -= sizes[s]
            moved.append(s)
    light = [(load[k], k) for k in range(shards)]
    heapq.heapify(light)
    for s in moved:
        have, k = heapq.heappop(light)
        owner[s] = k
        heapq.heappush(light, (have + sizes[s], k))
    return SlotMap(current.version + 1, shards, owner)


def digests(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The light columns of every record: id, size, checksum and virtual slot.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1). The slot hashes the id with
    the text, so records without an id spread as well.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(doc_id), body), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of each slot."""
    size, count = [0] * slots, [0] * slots
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    for r in found.collect():  # at most ``slots`` rows
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    return size, count


def shard_documents(
    docs: DataFrame,
    shards: int = 16,
    slots: int = SLOTS,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Every record's shard under a balanced slot map, and its place there.

    Shard sizes are near equal in bytes. Returns ``doc_id``, ``size``, ``text_crc32``,
    ``law`` (``bytes``), ``shard``, ``slot`` (the record's place in its shard, gapless
    from 0), ``grown_shard`` (null: this law may move rows between old shards when their
    sizes change), ``virtual_slot`` and ``map_version``. Records of a slot keep the order
    of their ids (ties by size and checksum; fully repeated rows are interchangeable).
    The map is stored under ``folder`` (the shared folder if none is given). An empty
    table gives no rows; a null id or text is a record like any other.
    """
    spark = docs.sparkSession
    rows = cut_lineage(digests(docs, slots, doc_id, text))
    sizes, counts = slot_sizes(rows, slots)
    placed = balanced_map(sizes, shards)
    placed.save(spark, folder or new_shared_path(spark, "slot-map"))
    first, filled = [0] * slots, [0] * shards
    for s, k in enumerate(placed.owner):
        first[s] = filled[k]
        filled[k] += counts[s]
    # One row per slot: a size fixed by the parameter.
    table = spark.createDataFrame(
        [(s, placed.owner[s], first[s]) for s in range(slots)], "virtual_slot int, shard int, first long"
    )
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("__place", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(table), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("__place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(placed.version).alias("map_version"),
    )

"""Shards of near equal size through fixed virtual slots.

A record is hashed into one of thousands of slots for good. The bytes of each slot are
summed, and a small versioned table maps slots to shards. Rebalancing never rehashes
records: it edits that table, moving whole slots from the fullest to the emptiest shard.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnledger.llm.frames import pin, prepare, scratch_path

VIRTUAL_SLOTS = 16_384
MAX_MOVES = 100_000
SEED = 20_11

MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, first_place long"


def with_slots(docs: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Thin rows with size, checksum and virtual slot; the slot depends on id and text only."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("record_hash"),
    ).withColumn("virtual_slot", F.pmod(F.col("record_hash"), F.lit(n_slots)).cast("int"))


def spread_repeats(rows: DataFrame, n_slots: int) -> DataFrame:
    """Deal the second and further copies of a row in a written part to slots of their own.

    Rows that agree in id and text would all lie in one slot, which no map can split. The first
    copy in each part keeps the record's slot; the others are hashed with their part and number.
    """
    part = pin(rows.withColumn("part", F.spark_partition_id()), "shard-hashes")
    copy = F.row_number().over(Window.partitionBy("part", "record_hash").orderBy("doc_id", "size"))
    dealt = F.pmod(F.xxhash64("record_hash", "part", "copy"), F.lit(n_slots)).cast("int")
    return part.withColumn("copy", copy).select(
        "doc_id", "size", "text_crc32", "record_hash",
        F.when(F.col("copy") == 1, F.col("virtual_slot")).otherwise(dealt).alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def rebalance(shard: np.ndarray, sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """Edit a slot-to-shard map until no move of one slot evens the fullest and emptiest shard.

    Slots of shards beyond ``n_shards`` are first dealt to the emptiest ones. Each further
    move takes the slot nearest to half the gap, so the gap only shrinks.
    """
    shard = shard.copy()
    load = np.zeros(n_shards, dtype=np.int64)
    kept = shard < n_shards
    np.add.at(load, shard[kept], sizes[kept])
    for slot in sorted(np.flatnonzero(~kept), key=lambda s: (-sizes[s], s)):
        shard[slot] = int(load.argmin())
        load[shard[slot]] += sizes[slot]
    held = [sorted((int(sizes[s]), int(s)) for s in np.flatnonzero((shard == k) & (sizes > 0))) for k in range(n_shards)]
    for _ in range(MAX_MOVES):
        full, bare = int(load.argmax()), int(load.argmin())
        gap = int(load[full] - load[bare])
        at = bisect.bisect_left(held[full], (gap // 2, -1))
        near = [i for i in (at - 1, at) if 0 <= i < len(held[full]) and held[full][i][0] < gap]
        if not near:
            break
        size, slot = held[full].pop(min(near, key=lambda i: abs(2 * held[full][i][0] - gap)))
        bisect.insort(held[bare], (size, slot))
        shard[slot] = bare
        load[full] -= size
        load[bare] += size
    return shard


def first_map(n_slots: int, n_shards: int) -> np.ndarray:
    return np.arange(n_slots) % n_shards


class SlotMap:
    """Stored versions of the slot-to-shard map, at most ``n_slots`` rows each."""

    def __init__(self, spark: SparkSession, path: str | None = None, n_slots: int = VIRTUAL_SLOTS):
        self.spark, self.n_slots = spark, n_slots
        self.path = path or scratch_path(spark, "slot-map")

    def write(self, version: int, shard: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Append a version; ``first_place`` is where the slot's rows begin in its shard."""
        order = np.lexsort((np.arange(self.n_slots), shard))
        before = np.cumsum(counts[order]) - counts[order]
        opens = np.searchsorted(shard[order], shard[order])
        first = np.empty(self.n_slots, dtype=np.int64)
        first[order] = before - before[opens]
        rows = [(version, s, int(shard[s]), int(sizes[s]), int(first[s])) for s in range(self.n_slots)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self, version: int | None = None) -> DataFrame:
        """One version of the map, the latest unless named."""
        stored = self.spark.read.schema(MAP_SCHEMA).parquet(self.path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        return stored.where(F.col("version") == version)

    def shards(self, version: int | None = None) -> np.ndarray:
        out = np.empty(self.n_slots, dtype=np.int64)
        for row in self.read(version).select("virtual_slot", "shard").collect():
            out[row["virtual_slot"]] = row["shard"]
        return out


def totals_by_slot(rows: DataFrame, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot; at most ``n_slots`` rows reach the driver."""
    sizes, counts = np.zeros(n_slots, dtype=np.int64), np.zeros(n_slots, dtype=np.int64)
    for row in slot_totals(rows).collect():
        sizes[row["virtual_slot"]], counts[row["virtual_slot"]] = row["slot_bytes"], row["slot_rows"]
    return sizes, counts


def shard_documents(docs: DataFrame, n_shards: int = 16, slot_map: SlotMap | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot, virtual_slot``.

    ``size`` is the UTF-8 length of the text (null: 0) plus 1, ``slot`` the place in the
    shard without gaps from 0. Version 1 of the map deals slots round robin, version 2 is
    its edit for the bytes found; shard sizes then differ by less than a slot. A stored map
    is edited from its latest version instead. Rows that agree in id and text are
    interchangeable; their copies are dealt over all slots, by where they lie in the input, so
    that no slot grows with them. Null ids are hashed like any other value. Texts are only
    measured and hashed, however long. An empty table gives no rows, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    stored = slot_map is not None
    slot_map = slot_map or SlotMap(spark)
    rows = pin(spread_repeats(with_slots(docs, slot_map.n_slots), slot_map.n_slots), "shard-rows")
    sizes, counts = totals_by_slot(rows, slot_map.n_slots)
    if stored:
        version = slot_map.read().first()["version"]
        shard = slot_map.shards(version)
    else:
        version, shard = 1, first_map(slot_map.n_slots, n_shards)
        slot_map.write(version, shard, sizes, counts)
    slot_map.write(version + 1, rebalance(shard, sizes, n_shards), sizes, counts)
    # The map has a fixed number of rows whatever the table holds, so it may be broadcast.
    latest = F.broadcast(slot_map.read(version + 1).select("virtual_slot", "shard", "first_place"))
    place = F.row_number().over(
        Window.partitionBy("virtual_slot").orderBy("record_hash", "doc_id", "size", "text_crc32")
    )
    return (
        rows.withColumn("place", place)
        .join(latest, "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("first_place") + F.col("place") - 1).cast("long").alias("slot"),
            "virtual_slot",
        )
    )


def op8_virtual_slots(spark, sf_dir):
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )

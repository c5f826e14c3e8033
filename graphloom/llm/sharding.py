"""Sharding by fixed virtual slots.

Every record is hashed into one of SLOTS virtual slots, which never change. Bytes and rows are summed per slot, and a
versioned slot-to-shard map, edited when the shards are rebalanced, says where each slot lives. Only the map, never the
hash, changes between versions, so a rebalance moves whole slots and no more of them than needed.

The law is `bytes`. The first version of a map, which knows no data, deals the slots out in turn. Whoever places records
reads the latest stored version, sums the bytes of its slots, and if an edit brings the heaviest and the lightest shard
closer by more than TOLERANCE of the mean, stores the edited version, which is then read back and used.

Defined cases: a null text counts as empty (size 8); a null doc_id hashes as such together with its text; the copies of a
repeated row, which no one can tell apart, are dealt over all slots, so that many of them don't weigh on one shard; an empty
table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192
SHARDS = 24
#: Bytes a record costs besides its text.
OVERHEAD = 8
#: How much closer, as a share of the mean, an edit must bring the shards.
TOLERANCE = 0.001


@dataclass
class SlotMap:
    """A version of the slot-to-shard map."""

    version: int
    n_shards: int
    shard_of: list[int] = field(default_factory=list)

    @classmethod
    def balanced(cls, weights: list[int], n_shards: int, version: int = 1) -> SlotMap:
        """The first map: heaviest slot first, each to the lightest shard."""
        heap, shard_of = [(0, s) for s in range(n_shards)], [0] * len(weights)
        for slot in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + weights[slot], shard))
        return cls(version, n_shards, shard_of)

    @classmethod
    def uniform(cls, slots: int, n_shards: int) -> SlotMap:
        """The first version, before any data is known."""
        return cls(1, n_shards, [k % n_shards for k in range(slots)])

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += weights[slot]
        return out

    def spread(self, weights: list[int]) -> float:
        """How far the heaviest and the lightest shard are apart, as a share of the mean."""
        load = self.loads(weights)
        return (max(load) - min(load)) / (sum(load) / self.n_shards or 1)

    def rebalanced(self, weights: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version. Slots of shards that are gone, then of those above the mean by more than the tolerance, go to the lightest shards; then single slots move from the heaviest to the lightest shard as long as that evens them out. All others stay."""
        n = n_shards or self.n_shards
        load, held, loose = [0] * n, [[] for _ in range(n)], []
        for slot, shard in enumerate(self.shard_of):
            if shard < n:
                load[shard] += weights[slot]
                held[shard].append(slot)
            else:
                loose.append(slot)
        mean, shard_of = sum(weights) / n, list(self.shard_of)
        for shard in range(n):
            for slot in sorted(held[shard], key=lambda k: (-weights[k], k)):
                if load[shard] - weights[slot] >= mean * (1 - tolerance) and load[shard] > mean * (1 + tolerance) and weights[slot]:
                    load[shard] -= weights[slot]
                    loose.append(slot)
        heap = [(load[s], s) for s in range(n)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda k: (-weights[k], k)):
            now, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (now + weights[slot], shard))
        new = SlotMap(self.version + 1, n, shard_of)
        load = new.loads(weights)
        held = [[] for _ in range(n)]
        for slot, shard in enumerate(shard_of):
            held[shard].append(slot)
        for _ in range(len(weights)):  # each move makes the two shards more alike
            high, low = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
            gap = load[high] - load[low]
            if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
                break
            slot = min((k for k in held[high] if 0 < weights[k] < gap), key=lambda k: (abs(2 * weights[k] - gap), k), default=None)
            if slot is None:
                break
            held[high].remove(slot)
            held[low].append(slot)
            shard_of[slot] = low
            load[high] -= weights[slot]
            load[low] += weights[slot]
        return new

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the versioned table at path."""
        rows = [(self.version, self.n_shards, json.dumps(self.shard_of))]
        spark.createDataFrame(rows, "version int, n_shards int, shard_of string").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        df = spark.read.parquet(path)
        df = df if version is None else df.filter(F.col("version") == version)
        row = df.orderBy(F.desc("version")).first()
        return cls(row.version, row.n_shards, json.loads(row.shard_of))

    def column(self, slot):
        """The shard of a slot column, as a lookup in a constant array of as many entries as there are slots."""
        return F.element_at(F.array(*[F.lit(s) for s in self.shard_of]), slot + 1)


def current_map(spark: SparkSession, path: str, slots: int, n_shards: int) -> SlotMap:
    """The latest version of the map stored at path; the first one, which is stored now, where there is none."""
    try:
        return SlotMap.load(spark, path)
    except AnalysisException:  # no such table
        first = SlotMap.uniform(slots, n_shards)
        first.save(spark, path)
        return SlotMap.load(spark, path)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, stored, since the copies of a repeated row are dealt by their place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("key"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = common.stored(rows, "records")
    repeated = common.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(True).alias("repeated")), "repeated")
    slot = F.pmod(F.when(F.col("repeated"), F.xxhash64("key", "place")).otherwise(F.col("key")), F.lit(slots)).cast("int")
    return common.stored(rows.join(common.if_small(repeated), "key", "left").select("doc_id", "size", "text_crc32", slot.alias("virtual_slot")), "slotted")


def slot_loads(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def shard(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (position in the shard, gapless from 0), grown_shard (null), virtual_slot, map_version.

    Only the sums of the slots, of which there are a fixed number, reach the driver. Positions are numbered inside each
    slot in parallel and shifted by the rows of the shard's earlier slots.
    """
    spark = docs.sparkSession
    records = slotted(docs, slots)
    loads = {r.virtual_slot: (r.bytes, r.n_rows) for r in slot_loads(records).collect()}
    weights = [loads.get(k, (0, 0))[0] for k in range(slots)]
    path = map_path or common.stored_path(spark, "slot-map")
    slot_map = current_map(spark, path, slots, n_shards)
    edited = slot_map.rebalanced(weights, n_shards, TOLERANCE)
    if slot_map.n_shards != n_shards or slot_map.spread(weights) - edited.spread(weights) > TOLERANCE:
        edited.save(spark, path)
        slot_map = SlotMap.load(spark, path)
    start, offsets = [0] * n_shards, []
    for k in range(slots):
        s = slot_map.shard_of[k]
        offsets.append((k, s, start[s]))
        start[s] += loads.get(k, (0, 0))[1]
    places = spark.createDataFrame(offsets, "virtual_slot int, shard int, first_position long")  # one row for each of a fixed number of slots
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return (
        records.withColumn("position", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_position") + F.col("position")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
        )
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the same placement: each record's size, and that no shard has a gap or a position twice."""
    placed = op8_sharding(spark, sf_dir)
    whole = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("positions"), F.max("slot").alias("last"), F.min("slot").alias("first"))
    sound = whole.agg(F.bool_and((F.col("n") == F.col("positions")) & (F.col("last") == F.col("n") - 1) & (F.col("first") == 0)).alias("gapless"))
    return placed.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(sound))


QUERIES = {"op8_sharding": op8_sharding, "sharding_sizes": sharding_sizes}
ORACLE_SQL: dict[str, str] = {
    "sharding_sizes": f"select doc_id, cast(octet_length(encode(coalesce(text, ''))) + {OVERHEAD} as bigint) as size, count(*) as n, true as gapless from documents group by all",
}

"""Sharding by fixed virtual slots: records hash into thousands of slots, a versioned map names each slot's shard.

Records never move between slots; only the map is edited.  Bytes and rows are aggregated per slot, the first version of the
map deals slots to shards by bytes, and a rebalancing writes the next version with as few slots changed as bring the
shards within a tolerance, or fill a shard that was added.  Versions stay readable, so a job that began under one
version ends under it.  A slot that is too heavy for one shard (a repeated id with very many rows) is divided into
parts, and the map has a row for each part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattshare.session import staged

#: Fixed number of slots; records weigh their bytes and this much more.
SLOTS, RECORD_BYTES = 8192, 8
#: A slot heavier than this share of a shard is divided into parts of about as much; most rows numbered by one task.
PART_SHARE, PART_ROWS = 1 / 32, 200_000
#: How far the heaviest shard may lie above the mean, as a share of it, before slots move.
TOLERANCE = 0.01

MAP_SCHEMA = "version int, slot int, part int, parts int, shard int, bytes long, n_rows long"


@dataclass(frozen=True)
class Piece:
    """A slot, or a part of one: its load and, once dealt, its shard."""

    slot: int
    part: int
    parts: int
    bytes: int
    n_rows: int
    shard: int = -1


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``_id, size, text_crc32, _slot, _mark``: a stored row per record; marks tell rows of one id apart."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(data).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(data).alias("text_crc32"), F.pmod(F.xxhash64(id_col), F.lit(slots)).cast("int").alias("_slot"),
        F.monotonically_increasing_id().alias("_mark"))
    return staged(rows, "shard-records")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("_id", "_mark"), parts).cast("int")


def slot_pieces(rows: DataFrame, shards: int, part_share: float = PART_SHARE, part_rows: int = PART_ROWS) -> list[Piece]:
    """Loads of all slots, heavy ones by parts.

    The driver holds a number per slot (a fixed number of them) and per part, of which there are at most ``shards / part_share``
    more by bytes and one more for each ``part_rows`` rows.
    """
    loads = rows.groupBy("_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")).collect()
    most = max(1.0, sum(r.bytes for r in loads) / shards * part_share)
    parts = {r["_slot"]: max(1, -(-r.bytes // int(most)), -(-r.n_rows // part_rows)) for r in loads}
    parts = {r["_slot"]: min(parts[r["_slot"]], r.n_rows) for r in loads}
    heavy = {s: p for s, p in parts.items() if p > 1}
    pieces = [Piece(r["_slot"], 0, 1, r.bytes, r.n_rows) for r in loads if r["_slot"] not in heavy]
    if heavy:
        divided = rows.join(F.broadcast(_table(rows.sparkSession, heavy)), "_slot")
        parted = divided.groupBy("_slot", _part(F.col("_parts")).alias("_part")).agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")).collect()
        pieces += [Piece(r["_slot"], r["_part"], heavy[r["_slot"]], r.bytes, r.n_rows) for r in parted]
    return sorted(pieces, key=lambda p: (p.slot, p.part))


def _table(spark: SparkSession, parts: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(list(parts.items()), "_slot int, _parts int")


def dealt(pieces: Sequence[Piece], shards: int) -> list[Piece]:
    """First version of the map: the heaviest piece goes to the lightest shard, in turn."""
    loads = [(0, s) for s in range(shards)]
    out = []
    for piece in sorted(pieces, key=lambda p: (-p.bytes, p.slot, p.part)):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + piece.bytes, shard))
        out.append(replace(piece, shard=shard))
    return sorted(out, key=lambda p: (p.slot, p.part))


def rebalanced(
    placed: Sequence[Piece], shards: int, tolerance: float = TOLERANCE, grow_only: bool = False,
) -> list[Piece]:
    """The map with some pieces moved, for new loads or another number of shards; all others stay where they are.

    From the heaviest shard to the lightest goes, each time, the piece nearest to half their difference, until no shard
    lies over the mean by more than ``tolerance`` or no piece helps.  ``grow_only``: pieces move into new
    shards alone (those that held nothing), up to the mean.  Pieces of shards that are given up move first.
    """
    held: dict[int, list[Piece]] = defaultdict(list)
    orphans = []
    for piece in placed:
        (held[piece.shard] if 0 <= piece.shard < shards else orphans).append(piece)
    loads = {s: sum(p.bytes for p in held[s]) for s in range(shards)}
    new = {s for s in range(shards) if not held[s]}
    for piece in sorted(orphans, key=lambda p: (-p.bytes, p.slot, p.part)):
        light = min(loads, key=lambda s: (loads[s], s))
        held[light].append(replace(piece, shard=light))
        loads[light] += piece.bytes
    mean = sum(loads.values()) / shards
    while loads:
        heavy = max(loads, key=lambda s: (loads[s], -s))
        targets = [s for s in loads if s in new] if grow_only else list(loads)
        light = min(targets, key=lambda s: (loads[s], s), default=heavy)
        gap = loads[heavy] - loads[light]
        done = loads[light] >= mean if grow_only else loads[heavy] <= mean * (1 + tolerance)
        options = [p for p in held[heavy] if p.bytes < gap]
        if done or heavy == light or not options:
            break
        moved = min(options, key=lambda p: (abs(gap / 2 - p.bytes), p.slot, p.part))
        held[heavy].remove(moved)
        held[light].append(replace(moved, shard=light))
        loads[heavy] -= moved.bytes
        loads[light] += moved.bytes
    return sorted((p for pieces in held.values() for p in pieces), key=lambda p: (p.slot, p.part))


def with_loads(pieces: Sequence[Piece], placed: Sequence[Piece]) -> list[Piece]:
    """New loads under an older map: a piece keeps its shard, a part the map lacks takes its slot's first shard."""
    by_part = {(p.slot, p.part, p.parts): p.shard for p in placed}
    by_slot = {p.slot: p.shard for p in reversed(placed)}
    return [replace(p, shard=by_part.get((p.slot, p.part, p.parts), by_slot.get(p.slot, -1))) for p in pieces]


# The stored map


def map_table(spark: SparkSession, placed: Sequence[Piece], version: int) -> DataFrame:
    return spark.createDataFrame(
        [(version, p.slot, p.part, p.parts, p.shard, p.bytes, p.n_rows) for p in placed], MAP_SCHEMA)


def store_map(spark: SparkSession, placed: Sequence[Piece], path: str) -> int:
    """Append the next version to the table at ``path``; versions are never rewritten.  Returns its number."""
    version = (latest_version(spark, path) or 0) + 1
    map_table(spark, placed, version).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def latest_version(spark: SparkSession, path: str) -> int | None:
    if not _exists(spark, path):
        return None
    return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[Piece]:
    """The pieces of a version, the latest unless told."""
    wanted = latest_version(spark, path) if version is None else version
    rows = spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == F.lit(wanted)).collect()
    return sorted((Piece(r.slot, r.part, r.parts, r.bytes, r.n_rows, r.shard) for r in rows), key=lambda p: (p.slot, p.part))


# Records under a map


def located(rows: DataFrame, placed: Sequence[Piece]) -> DataFrame:
    """``rows`` with ``shard`` and ``place``, gapless from 0 in each shard.

    Pieces of a shard follow each other in the order of slot and part, rows within a piece by id, checksum and mark; where
    a piece begins is known from the map, so only rows of one piece are numbered together.
    """
    begun: dict[int, int] = defaultdict(int)
    named = []
    for piece in placed:
        named.append((piece.slot, piece.part, piece.parts, piece.shard, begun[piece.shard]))
        begun[piece.shard] += piece.n_rows
    spark = rows.sparkSession
    # Both are bounded by the number of slots and parts.
    places = spark.createDataFrame(named, "_slot int, _part int, _parts int, shard int, _begin long")
    parts = places.groupBy("_slot").agg(F.max("_parts").alias("_parts"))
    parted = rows.join(F.broadcast(parts), "_slot").withColumn("_part", _part(F.col("_parts")))
    number = F.row_number().over(Window.partitionBy("_slot", "_part").orderBy("_id", "text_crc32", "_mark")) - 1
    return parted.withColumn("_number", number).join(F.broadcast(places.drop("_parts")), ["_slot", "_part"]).withColumn(
        "place", (F.col("_begin") + F.col("_number")).cast("long"))


def sharded(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS,
    map_path: str | None = None, tolerance: float = TOLERANCE, part_share: float = PART_SHARE, part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, size, text_crc32, shard, slot`` (its place in the shard, gapless from 0).

    ``size``: UTF-8 bytes of the text and ``RECORD_BYTES``.  Shards have nearly equal sums of sizes.  With ``map_path`` the
    latest stored map is edited for the present loads and ``shards``, and stored as the next version if it
    changed; without, a first map is made.

    Null and empty texts weigh ``RECORD_BYTES``; null ids hash like any other; rows that repeat an id share a slot, which is
    divided if it is heavy; texts are read once, whole, and enter no shuffle; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = records(docs, id_col, text_col, slots)
    pieces = slot_pieces(rows, shards, part_share, part_rows)
    if map_path is not None and latest_version(spark, map_path) is not None:
        before = read_map(spark, map_path)
        placed = rebalanced(with_loads(pieces, before), shards, tolerance)
        if placed != before:
            store_map(spark, placed, map_path)
    else:
        placed = dealt(pieces, shards)
        if map_path is not None:
            store_map(spark, placed, map_path)
    return located(rows, placed).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", F.col("place").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", **options) -> None:
    """Whole records as Parquet, one folder per shard, for ids that are unique and not null."""
    where = sharded(docs, shards, id_col, **options).select(id_col, F.col("shard").alias("_shard"))
    docs.join(where, id_col).write.partitionBy("_shard").parquet(path)

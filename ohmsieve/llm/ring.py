"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells; each shard owns many virtual nodes, and
a cell belongs to the first node at or after it.  A shard takes the rows of
its own cells, in ring order, up to its bound; what overflows goes on
clockwise to the next nodes whose shard is not full.  The bounds are the
counts at most one apart that add up to all rows (law ``rows``), so the
balance is exact, and only overflowing rows leave their own shard.  With many
nodes a shard the shards' own cells differ by a few percent, so few rows
overflow, and a new shard or row moves little else.

The walk works on counts per cell, whose number is a parameter; rows then find
their shard by their rank in their cell.  A cell with very many rows is ranked
in parts, by a number that each row has got in a written table, so that equal
rows spread too.

Defined cases: a null text has size 16 and the crc32 of nothing; a null
``doc_id`` is placed by its text; equal rows are placed each; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, read

SHARDS = 40
CELLS = 1 << 16
NODES = 256
#: Rows of a cell that are ranked together, on average at most.
RANK_ROWS = 100_000


def nodes(shards: int, per_shard: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; where two meet in a cell, the smaller shard has it."""
    got: dict[int, int] = {}
    for s in range(shards):
        for v in range(per_shard):
            h = zlib.crc32(f"shard {s} node {v}".encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            cell = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 64 - (cells - 1).bit_length()
            got[cell] = min(s, got.get(cell, s))
    return sorted(got.items())


def walk(counts: dict[int, int], shards: int, per_shard: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, rows, shard, first slot) that place every row."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    ring = nodes(shards, per_shard, cells)
    at = [c for c, _ in ring]
    slot, runs, over = [0] * shards, [], []

    def put(cell: int, rank: int, n: int, s: int) -> None:
        runs.append((cell, rank, n, s, slot[s]))
        slot[s] += n
        room[s] -= n

    for cell in sorted(counts):
        k = bisect_left(at, cell) % len(ring)
        s, n = ring[k][1], counts[cell]
        if take := min(n, room[s]):
            put(cell, 0, take, s)
        if n > take:
            over.append((cell, take, n - take, k))
    after = [(k + 1) % len(ring) for k in range(len(ring))]
    owners = {s for _, s in ring}
    left = sum(room[s] for s in owners)
    for cell, rank, n, k in over:
        while n:
            if left:
                seen = []
                while not room[s := ring[k][1]]:
                    seen.append(k)
                    k = after[k]
                for x in seen:  # a full shard stays full, so its nodes are passed over from now on
                    after[x] = k
            else:  # a shard may have lost all its nodes to others
                s = max(range(shards), key=room.__getitem__)
            put(cell, rank, take := min(n, room[s]), s)
            left -= take if s in owners else 0
            rank, n = rank + take, n - take
    return runs


def assign(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS, per_shard: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lit(-1), "text_crc32", "size"))
    rows = rows.withColumn("_h", key).withColumn("_cell", F.shiftrightunsigned("_h", 64 - (cells - 1).bit_length()).cast("int"))
    rows = Workspace(spark, "ring").table("rows", rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    counts = {r[0]: r[1] for r in rows.groupBy("_cell").agg(F.count(F.lit(1))).collect()}  # at most `cells` rows
    runs = spark.createDataFrame(walk(counts, shards, per_shard, cells) or [(0, 0, 0, 0, 0)], "_cell int, _from long, _n long, shard int, _slot long")
    wide = [(c, -(-n // RANK_ROWS)) for c, n in counts.items() if n > RANK_ROWS]
    part = F.lit(0)
    if wide:
        rows = rows.join(F.broadcast(spark.createDataFrame(wide, "_cell int, _parts int")), "_cell", "left")  # at most `cells` rows
        part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod("_salt", F.col("_parts"))).cast("int")
    rows = rows.withColumn("_part", part)
    rank = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_h", "doc_id", "size", "text_crc32")).cast("long") - 1
    ranked = rows.withColumn("_rank", rank)
    if wide:
        before = F.coalesce(F.sum("_k").over(Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = rows.filter("_parts IS NOT NULL").groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_k")).select("_cell", "_part", before.alias("_before"))
        ranked = ranked.join(ahead, ["_cell", "_part"], "left").withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    placed = ranked.join(runs, (ranked["_cell"] == runs["_cell"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))

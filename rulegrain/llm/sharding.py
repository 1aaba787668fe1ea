"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rulegrain.llm.common import stored, table, text_of

CELLS = 1 << 16


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a shard's nodes stay where they are when others come."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            cell = int(hashlib.md5(f"{shard}:{node}".encode()).hexdigest()[:8], 16) % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def arcs_of(nodes: list[tuple[int, int]]) -> list[dict]:
    """The runs of cells that end at each virtual node; cells after the last node belong to the first."""
    runs, start = [], 0
    for arc, (cell, _) in enumerate(nodes):
        runs.append({"arc": arc, "start": start, "stop": cell})
        start = cell + 1
    return runs + ([{"arc": 0, "start": start, "stop": CELLS - 1}] if start < CELLS else [])


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows of the driver as a table, without Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def flow(counts: dict[int, int], owners: list[int], room: list[int]) -> list[dict]:
    """Ranges of ranks with shard and first slot: where the rows of each arc go when full shards pass them on clockwise.

    Works on counts alone: in round k every arc offers what is left of it to the k-th node after its own.
    Once shards are full, whole runs of nodes are passed at no cost but one step each.
    """
    room, filled, out = list(room), [0] * len(room), []
    waiting = {arc: (0, count) for arc, count in sorted(counts.items()) if count}
    for ahead in range(len(owners)):
        if not waiting:
            break
        for arc in list(waiting):
            start, count = waiting[arc]
            shard = owners[(arc + ahead) % len(owners)]
            placed = min(count - start, room[shard])
            if placed:
                out.append({"arc": arc, "start": start, "stop": start + placed, "shard": shard, "slot0": filled[shard]})
                room[shard] -= placed
                filled[shard] += placed
                if start + placed == count:
                    del waiting[arc]
                else:
                    waiting[arc] = (start + placed, count)
    return out


def shard_rows(docs: DataFrame, shards: int = 24, nodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row.

    A text's hash is its place on the ring, so equal texts meet in one shard while it has room. Shards hold
    at most ceil((1 + slack) * rows / shards) rows; with slack 0 the bounds add up to the rows, so counts
    differ by one at most. Rows over a bound continue clockwise. Only the counts of the ring's arcs (at
    most shards * nodes numbers) reach the driver; the rows' places inside an arc are counted by 256 id
    hashes per ring cell, so one text that a third of the rows share is spread over tasks.

    Null texts count as empty (size 8); null ids are ordinary ids; repeated rows get slots of their own;
    an empty table gives no rows; other columns are ignored.
    """
    points = ring(shards, nodes)
    owners = [shard for _, shard in points]
    spark = docs.sparkSession
    hashed = F.xxhash64("text")
    rows = stored(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        hashed.alias("place"), F.pmod(hashed, F.lit(CELLS)).cast("int").alias("cell"),
        F.pmod(F.xxhash64("id", F.lit("lot")), F.lit(256)).cast("int").alias("part"),
    ))
    lookup = small_table(spark, arcs_of(points), "arc:int,start:int,stop:int").select("arc", F.explode(F.sequence("start", "stop")).alias("cell"))
    lookup = F.broadcast(lookup)  # 65,536 rows at any size of the data
    parts = stored(rows.groupBy("cell", "part").count().join(lookup, "cell"))
    counts = {row["arc"]: row["rows"] for row in parts.groupBy("arc").agg(F.sum("count").alias("rows")).collect()}
    total = sum(counts.values())
    if slack:
        room = [int(-(-(1 + slack) * total // shards))] * shards
    else:
        room = [total // shards + (shard < total % shards) for shard in range(shards)]
    moves = small_table(spark, flow(counts, owners, room), "arc:int,start:bigint,stop:bigint,shard:int,slot0:bigint")
    before = Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("cell", "part", "arc", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cell", "part").orderBy("place", F.col("id").asc_nulls_last(), "text_crc32")
    placed = rows.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, ["cell", "part"])
    placed = placed.withColumn("__rank", F.col("__rank") + F.col("before"))
    fits = (F.col("__rank") >= F.col("start")) & (F.col("__rank") < F.col("stop"))
    return (
        placed.join(F.broadcast(moves.withColumnRenamed("arc", "__arc")), (F.col("arc") == F.col("__arc")) & fits)  # bounded by the ring
        .select("id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("__rank") - F.col("start")).cast("long").alias("slot"))
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    found = shard_rows(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLE: dict[str, str] = {}

"""Building blocks that keep jobs even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulegrain.session import cut_lineage

BLOCK_ROWS = 8192
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 1000


def size_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the table is small enough to broadcast; reads at most ``max_rows + 1`` rows."""
    probe = df.limit(max_rows + 1).select(F.length(F.to_json(F.struct("*"))).cast("long").alias("width"))
    row = probe.agg(F.count("*").alias("rows"), F.coalesce(F.sum("width"), F.lit(0)).alias("bytes")).first()
    return row["rows"] <= max_rows and row["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, **limits: int) -> DataFrame:
    """A broadcast hint behind a size check; past the limit the join is a shuffled one."""
    return F.broadcast(df) if size_checked(df, **limits) else df


def fill_cores(df: DataFrame) -> DataFrame:
    """Spread an input with fewer partitions than cores, such as one small file, over all cores.

    Inputs of ordinary size already have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank") -> DataFrame:
    """First ``limit`` rows per key. Spark prunes each map task to ``limit`` rows per key first."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def ordered_distinct(
    df: DataFrame, keys: Sequence[str], value: str, order: str | Column, limit: int | None, alias: str
) -> DataFrame:
    """Distinct values per key by first appearance, as one array of at most ``limit`` members.

    Duplicates merge map-side before anything is collected. ``limit=None`` is for values whose
    distinct count per key is small by nature (labels of one record, for example).
    """
    order = F.col(order) if isinstance(order, str) else order
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    if limit is not None:
        first = top_rows(first, keys, [F.col("_first"), F.col(value)], limit, "_rank")
    pairs = F.sort_array(F.collect_list(F.struct(F.col("_first"), F.col(value).alias("value"))))
    return first.groupBy(*keys).agg(F.transform(pairs, lambda pair: pair["value"]).alias(alias))


def number_rows(df: DataFrame, order: Sequence[str | Column], alias: str = "number", start: int = 1) -> DataFrame:
    """Number all rows 1..n in a global order without bringing them into one task.

    Range partitioning sorts, each partition counts, and the running partition offsets (one row per
    partition) are joined back. The partitioned rows are written out first so that a recomputed
    task cannot see other range bounds.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn(
            "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")  # at most one row per shuffle partition
        .withColumn(alias, (F.col("_offset") + F.col("_at") + F.lit(start)).cast("long"))
        .drop("_part", "_at", "_offset")
    )


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Hashes (``_key``) of all keys that more than one row has, and of few others: hashes of 8 bytes are counted, not the keys."""
    counted = df.select(F.xxhash64(*keys).alias("_key")).groupBy("_key").agg(F.count("*").alias("_rows"))
    return cut_lineage(counted.filter(F.col("_rows") > 1).select("_key"))


def split_repeated(df: DataFrame, *keys: str, repeated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key surely no other row has, and the rest: where keys are mostly unique, only the rest need meet by key.

    ``repeated`` is what :func:`repeated_keys` found for the keys of these rows, where that is known already.
    """
    known = broadcast_if_small(repeated_keys(df, *keys) if repeated is None else repeated)
    keyed = df.withColumn("_key", F.xxhash64(*keys))
    return keyed.join(known, "_key", "left_anti").drop("_key"), keyed.join(known, "_key", "left_semi").drop("_key")


def _blocked(df: DataFrame, order: str, block_rows: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows)))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str | Column, alias: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Inclusive running sum over a dense line number, safe for a key with very many lines.

    Lines are summed inside blocks of ``block_rows``; only block totals meet in one window.
    """
    value = F.col(value) if isinstance(value, str) else value
    blocks = _blocked(df.withColumn("_value", value.cast("long")), order, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_local", F.sum("_value").over(inside))
    totals = blocks.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    return (
        local.join(carried, [*keys, "_block"])
        .withColumn(alias, F.col("_carried") + F.col("_local"))
        .drop("_block", "_value", "_local", "_carried")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str | Column, alias: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Latest non-null value up to each line, with the same block scheme as :func:`running_sum`."""
    value = F.col(value) if isinstance(value, str) else value
    blocks = _blocked(df.withColumn("_value", value), order, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    lasts = blocks.groupBy(*keys, "_block").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    return (
        local.join(carried, [*keys, "_block"])
        .withColumn(alias, F.coalesce("_local", "_carried"))
        .drop("_block", "_value", "_local", "_carried")
    )


def spread_join(
    many: DataFrame, few: DataFrame, on: Sequence[str], row_id: Sequence[str], how: str = "inner",
    salts: int = 64, min_rows: int = 100_000, sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi join whose left side may have hot keys; the right side has few rows per key.

    The (at most ``HOT_KEYS``) largest keys are found by a pre-aggregated count. Their left rows are
    spread over ``salts`` partitions by a hash of ``row_id`` and their right rows are repeated once
    per salt; every other key joins as usual. The result equals the plain join. ``sizes`` has a
    ``count`` for each key where it is known already, so that the left side is not read for it; keys
    that it lacks are not spread.
    """
    counted = many.groupBy(*on).count() if sizes is None else sizes
    hot = (
        counted.filter(F.col("count") >= min_rows)
        .orderBy(F.desc("count"), *on).limit(HOT_KEYS).select(*on, F.lit(True).alias("_hot"))
    )
    hot = F.broadcast(cut_lineage(hot))  # bounded by HOT_KEYS
    spread = F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")
    left = many.join(hot, list(on), "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    right = (
        few.join(hot, list(on), "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("_hot")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")

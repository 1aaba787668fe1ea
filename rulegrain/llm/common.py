"""Shared pieces: table access, stored stages, stable row keys and fixed-size membership bitmaps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts and the words between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Row keys of :func:`with_row_key`.
ROW_KEY = ["__row_file", "__row_at"]

BITMAP_ROWS = 32_768  # bits of one row of bitmap_construct_agg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a temporary folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this operator")
        folder = tempfile.mkdtemp(prefix="rulegrain-llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and read it back: it survives lost executors and freezes row ids."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add a key that names a row by its file and place there, whatever the splits; frames without files are stored first."""
    if set(ROW_KEY) <= set(df.columns):
        return df
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(ROW_KEY[0]), F.col("_metadata.row_index").alias(ROW_KEY[1]))
    except AnalysisException:
        return with_row_key(stored(df))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def membership_bitmap(keys: DataFrame, columns: list[str], bits: int = 24) -> DataFrame:
    """A bitmap of 2**bits bits with one set for the hash of each key row: at most 2**bits / 8 bytes, however many keys."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    return (
        keys.select(F.bitmap_bucket_number(slot).alias("__bucket"), F.bitmap_bit_position(slot).alias("__bit"))
        .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )


def mark_members(df: DataFrame, bitmap: DataFrame, columns: list[str], flag: str, bits: int = 24) -> DataFrame:
    """Add a flag that is true for every member and, by hash collision, for few others. The broadcast has a fixed size."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
    place = F.bitmap_bit_position(slot)
    octet = F.conv(F.hex(F.substring(F.col("__bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return (
        df.withColumn("__bucket", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bitmap), "__bucket", "left")
        .withColumn(flag, F.coalesce(F.getbit(octet, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False)))
        .drop("__bucket", "__bits")
    )


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` (with row keys) less the rows whose keys are in ``dropped``; only rows that may be dropped are shuffled."""
    columns = [name for name in docs.columns if name not in ROW_KEY]
    flagged = mark_members(docs, membership_bitmap(dropped, ROW_KEY), ROW_KEY, "__maybe")
    safe = flagged.filter(~F.col("__maybe")).select(*columns)
    checked = flagged.filter("__maybe").join(dropped.select(*ROW_KEY), ROW_KEY, "left_anti").select(*columns)
    return safe.unionByName(checked)

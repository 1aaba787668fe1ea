"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulegrain.llm.common import ROW_KEY, SPACE, mark_members, membership_bitmap, stored, table, text_of, with_row_key, without_rows


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, bits: int = 24, digest_all: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its key, id, keeper, group size, whether it stays, and digest.

    Texts are equal when equal without white space. A first scan takes only the length and the hash of
    the first ``prefix`` characters; lengths held once go, then (length, prefix hash) pairs held once go.
    The second scan hashes whole texts of the surviving pairs alone. Survivors are recognised by a bitmap
    of 2**bits bits, so nothing that grows with the data is broadcast; its false positives only cost a hash.

    Nulls count as empty texts; empty texts equal each other. The longest original text stays, then the
    smallest id (null ids last), then, between repeated rows, the first in the files: exactly one row of a
    group stays. An empty table gives no rows; other columns are ignored, whatever their names.
    ``digest_all`` also fills the digest of rows that were ruled out before (else null).
    """
    rows = with_row_key(docs).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *ROW_KEY)
    bare = F.regexp_replace("text", SPACE, "")
    bare_rows = rows.select("id", *ROW_KEY, F.length("text").alias("chars"), bare.alias("bare"))
    sketched = bare_rows.withColumns({"size": F.length("bare"), "head": F.xxhash64(F.substring("bare", 1, prefix))})

    first = stored(sketched.groupBy("size", "head").count())
    lengths = first.groupBy("size").agg(F.sum("count").alias("rows")).filter("rows > 1")
    same_length = mark_members(first, membership_bitmap(lengths, ["size"], 20), ["size"], "__length", 20).filter("__length")
    heads = same_length.filter("count > 1")
    read = mark_members(sketched, membership_bitmap(heads, ["size", "head"], bits), ["size", "head"], "survives", bits)
    digest = F.sha2(F.col("bare").cast("binary"), 256)
    decided = stored(read.select(
        "id", *ROW_KEY, "chars", "survives",
        (digest if digest_all else F.when(F.col("survives"), digest)).alias("digest"),
    ))

    rank = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"), *ROW_KEY)
    groups = stored(
        decided.filter("survives").groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(rank).alias("first"))
        .select("digest", "group_size", F.col("first.id").alias("keep_id"), *[F.col(f"first.{key}").alias(f"keep{key}") for key in ROW_KEY])
    )
    kept = F.lit(True)
    for key in ROW_KEY:
        kept = kept & (F.col(key) == F.col(f"keep{key}"))
    columns = [*ROW_KEY, "id", "keep_id", "group_size", "kept", "digest"]
    grouped = decided.filter("survives").join(groups, "digest").withColumn("kept", kept).select(*columns)
    single = decided.filter("NOT survives").select(
        *ROW_KEY, "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return grouped.unionByName(single)


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    keyed = with_row_key(docs)
    decided = exact_duplicates(keyed, id_col, text_col)
    return without_rows(keyed, decided.filter("NOT kept").select(*ROW_KEY))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE = {
    "op2_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""
}

"""SimHash near-dedup: pigeonring filtering finds fingerprints within a few bits, and chains of links become groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.llm.common import mark_members, membership_bitmap, stored, table, text_of
from rulegrain.llm.near_dedup import components

SEED = 42
BOXES, BOX_BITS = 16, 4  # a fingerprint is a ring of 16 segments of 4 bits
BUCKET = 512  # fingerprints that one task compares together; larger buckets are refined


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words than ``size`` are one shingle, none give no hash.

    Words are what ASCII white space parts; A-Z count as a-z.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    wide = min(size, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - wide + 1]
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[start:end], SEED) for start, end in zip(starts.tolist(), ends[wide - 1:].tolist(), strict=True))
    return np.fromiter(found, dtype=np.uint64, count=len(starts))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 bits, each set when it is set in over half of the shingle hashes; zero without words."""
    hashes = shingle_hashes(text, size)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        octets = hashes[start:start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``print`` (the fingerprint as a signed long) of every row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(text, size) for text in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "print": prints.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))  # as text, ids beside nulls stay exact
    return rows.mapInPandas(sign, "id string, print long").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def free_chain(boxes: int, reach: int) -> int:
    """Segments at the head of a viable chain that must be equal: those whose proportional budget is under one bit."""
    return max(1, -(-boxes // reach) - 1) if reach else boxes


def refined(rows: DataFrame, boxes: int, reach: int) -> DataFrame:
    """Bucket rows by every chain over the ring of their ``boxes`` unfixed segments (column ``rest``).

    Two values that differ in at most ``reach`` bits of the ring have a start from which every run of k segments differs
    in at most k * reach / boxes bits, so the first segments, while that is under one, are equal and serve as join key.
    ``start`` keeps the chain of the first level.
    """
    fixed = free_chain(boxes, reach)
    full = (1 << (BOX_BITS * boxes)) - 1
    left_over = BOX_BITS * (boxes - fixed)

    def low(value: Column, bits: int) -> Column:
        return value if bits >= 64 else value.bitwiseAND(F.lit((1 << bits) - 1))

    def at(turn: int) -> Column:
        head = F.shiftrightunsigned(F.col("rest"), BOX_BITS * (boxes - turn)) if turn else F.lit(0).cast("long")
        turned = F.shiftleft(F.col("rest"), BOX_BITS * turn).bitwiseOR(head)
        turned = turned if full >= (1 << 64) - 1 else low(turned, BOX_BITS * boxes)
        lead = F.shiftrightunsigned(turned, left_over)
        start = F.coalesce(F.col("start"), F.lit(turn))
        return F.struct(F.xxhash64("key", F.lit(turn), lead).alias("key"), start.alias("start"), low(turned, left_over).alias("rest"))

    return rows.select("print", F.explode(F.array(*[at(turn) for turn in range(boxes)])).alias("to")).select("print", "to.*")


def forest(prints: np.ndarray, start: int, reach: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one bucket, whose chain begins at ``start``."""
    differ = prints[:, None] ^ prints
    turned = differ if not start else (differ << np.uint64(BOX_BITS * start)) | (differ >> np.uint64(64 - BOX_BITS * start))
    viable = np.ones(differ.shape, dtype=bool)
    for length in range(1, BOXES):
        budget = length * reach // BOXES
        if budget < (length + 1) * reach // BOXES:  # the last length under this budget binds
            viable &= np.bitwise_count(turned >> np.uint64(64 - BOX_BITS * length)) <= budget
    linked = viable & (np.bitwise_count(differ) <= reach)
    links, waiting = [], np.ones(len(prints), dtype=bool)
    for root in range(len(prints)):
        if waiting[root]:
            waiting[root] = False
            todo = [root]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(linked[at] & waiting)
                waiting[new] = False
                todo.extend(new.tolist())
                links += [(at, int(other)) for other in new]
    return links


def compared(rows: DataFrame, reach: int) -> DataFrame:
    """Links (a, b) inside buckets of a bounded number of fingerprints: chain budgets, then the full Hamming check."""
    buckets = rows.groupBy("key", "start").agg(F.collect_set("print").alias("prints")).filter(F.size("prints") > 1)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for start, prints in zip(batch["start"], batch["prints"], strict=True):
                values = np.asarray(prints, dtype=np.int64)
                found += [(values[a], values[b]) for a, b in forest(values.view(np.uint64), int(start), reach)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return buckets.select("start", "prints").mapInPandas(check, "a long, b long")


def links(prints: DataFrame, reach: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join every two of the distinct ``print`` values within ``reach`` bits, directly or over others.

    Buckets of the pigeonring chains with at most ``bucket`` values are compared inside a task, which emits a spanning
    forest. A larger one is never collected: its rows are refined by a chain over the segments not yet fixed, level by level,
    until buckets are small; two free segments are left at last, so at most 256 values can be. ``reach`` is 1 to 4.
    """
    if not 1 <= reach <= 4:
        raise ValueError("reach must be 1 to 4")
    boxes = BOXES
    rows = refined(prints.select("print", F.lit(0).cast("long").alias("key"), F.lit(None).cast("int").alias("start"), F.col("print").alias("rest")), boxes, reach)
    found = []
    while True:
        boxes -= free_chain(boxes, reach)
        if boxes <= 2:
            found.append(compared(rows, reach))
            break
        large = stored(rows.groupBy("key").count().filter(F.col("count") > bucket).select("key"))
        if large.isEmpty():
            found.append(compared(rows, reach))
            break
        marked = mark_members(rows, membership_bitmap(large, ["key"]), ["key"], "__maybe")
        maybe = marked.filter("__maybe").drop("__maybe")
        small = marked.filter("NOT __maybe").drop("__maybe").unionByName(maybe.join(large, "key", "left_anti"))
        found.append(compared(small, reach))
        rows = refined(stored(maybe.join(large, "key", "left_semi")), boxes, reach)
    all_of = found[0]
    for more in found[1:]:
        all_of = all_of.unionByName(more)
    return all_of


def near_groups(docs: DataFrame, size: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``print`` and ``component_id`` (smallest id that links reach) of every row, over whole texts.

    Rows of one fingerprint are one value, compared once, so copies cost no pairs. Null, empty and wordless texts have
    fingerprint zero and link like any other. Repeated rows stay; null ids are never a component's id unless it has no other.
    An empty table gives no rows; columns other than the two named play no part.
    """
    signed = stored(fingerprints(docs, size, id_col, text_col))
    firsts = stored(signed.groupBy("print").agg(F.min("id").alias("first")))
    labels = components(stored(links(firsts.select("print"), reach))).withColumnRenamed("node", "print")
    labelled = stored(firsts.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print")))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return signed.join(labelled.join(smallest, "label").select("print", "component_id"), "print")


def keep_one_of_each(docs: DataFrame, size: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose id is not the smallest of its group; rows with a null id stay."""
    found = near_groups(docs, size, reach, id_col, text_col)
    dropped = stored(found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_col)).distinct())
    return docs.join(dropped, id_col, "left_anti")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op13_simhash": op13_simhash}
ORACLE: dict[str, str] = {}

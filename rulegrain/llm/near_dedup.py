"""MinHash near-dedup with HyperMinHash registers: bands, collision-corrected estimates, then checks on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from rulegrain.llm.common import ROW_KEY, mark_members, membership_bitmap, stored, table, text_of, with_row_key, without_rows

BANDS, ROWS, MANTISSA = 32, 4, 10  # 128 registers of 6 + 10 bits; four of them make one 64-bit band key
REGISTERS = BANDS * ROWS
_random = np.random.default_rng(20)
_FACTORS = _random.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_MASKS = [int(x) for x in _random.integers(0, 1 << 62, BANDS)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than ``size`` make one shingle, none make an empty set.

    Words are what ASCII white space parts; A-Z count as a-z. ``known`` is a task's own memory of word hashes.
    """
    known = {} if known is None else known
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(known) > 100_000:
        known.clear()
    for word in words:
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    wide = min(size, len(words))
    total = np.full(len(words) - wide + 1, wide, dtype=np.uint64)
    for at in range(wide):
        total = _scramble(total * _MIX + hashes[at:len(hashes) - wide + 1 + at])
    return np.unique(total)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The 128 compressed minima: leading zeros above ten mantissa bits, as uint16."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start:start + 4096, None] * _FACTORS + _SHIFTS
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    return ((zeros << MANTISSA) | np.floor((fraction * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.int64)).astype(np.uint16)


def estimates(equal: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard from the count of equal registers, less the accidental matches expected of sets of these sizes."""
    ratio = left / np.maximum(right, 1)
    expected = 0.169919487159739 * REGISTERS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - expected) / (REGISTERS - expected)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Row key, id, shingle count, set fingerprint and band keys of every row; the last two null for empty sets."""
    rows = with_row_key(docs).select(*ROW_KEY, F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            counts, prints, bands = [], [], []
            for text in batch["text"]:
                shingles = shingle_set(text, size, known)
                counts.append(len(shingles))
                prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                bands.append(registers(shingles).view(np.int64) if len(shingles) else None)
            yield batch[[*ROW_KEY, "id"]].assign(n=counts, fingerprint=prints, bands=bands)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(sign, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kind}, n long, fingerprint binary, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node that it reaches) for all nodes of the edges (a, b).

    Each round takes the smallest label among neighbours, then the label of that label, so long chains halve.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    loops = both.select("a", F.col("a").alias("b"))
    graph = stored(both.unionByName(loops).distinct())
    labels = stored(graph.groupBy("a").agg(F.min("b").alias("label")))
    while True:
        near = stored(graph.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("label")))
        jump = near.select(F.col("a").alias("label"), F.col("label").alias("__next"))
        moved = stored(near.join(jump, "label").select("a", F.col("__next").alias("label")))
        old = labels.select("a", F.col("label").alias("__old"))
        if moved.join(old, "a").filter("label <> __old").isEmpty():
            return moved.withColumnRenamed("a", "node")
        labels = moved


def _matrix(bands: pd.Series) -> np.ndarray:
    return np.stack(list(bands)).view(np.uint16) if len(bands) else np.empty((0, REGISTERS), dtype=np.uint16)


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = np.concatenate([one, two])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the corrected estimate to pairs (a, b) of classes."""
    side = lambda name: classes.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("bands").alias(f"bands_{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bands_a", "bands_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            equal = (_matrix(batch["bands_a"]) == _matrix(batch["bands_b"])).sum(axis=1)
            yield batch[["a", "b"]].assign(estimate=estimates(equal, batch["n_a"].to_numpy(float), batch["n_b"].to_numpy(float)))

    return rows.mapInPandas(compare, "a long, b long, estimate double")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda name: texts.select(F.col("class").alias(name), F.col("text").alias(f"text_{name}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            last: tuple[int, np.ndarray] = (-1, np.empty(0, dtype=np.uint64))
            keep = []
            for b, one, two in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last[0]:
                    last = (b, shingle_set(two, size, known))
                keep.append(_linked(shingle_set(one, size, known), last[1], percent))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return rows.mapInPandas(check, "a long, b long")


def across(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, least: float, block: int = 256) -> DataFrame:
    """Links between different components inside buckets, all of them, without emitting a bucket's pairs.

    In a bucket with several components, every member outside the largest one is compared with every member
    of other components, block against block; only links leave the task. A pair that meets in several
    bands is looked at in the first.
    """
    known = members.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    sizes = known.groupBy("band", "key", "label").count()
    buckets = stored(
        sizes.groupBy("band", "key").agg(F.count("*").alias("labels"), F.max(F.struct("count", "label")).alias("top"))
        .filter("labels > 1").select("band", "key", F.col("top.label").alias("main")))
    active = stored(known.join(buckets, ["band", "key"]).select("band", "key", "class", "label", (F.col("label") != F.col("main")).alias("minor")))
    full = active.join(classes.select("class", "n", "bands"), "class").join(texts, "class")

    def packed(rows: DataFrame, counted: DataFrame, rows_each: int, tag: str) -> DataFrame:
        counts = stored(counted.groupBy("band", "key").agg(F.ceil(F.count("*") / rows_each).alias("__blocks")))
        split = rows.join(counts, ["band", "key"]).withColumn("__block", F.pmod(F.xxhash64("class"), F.col("__blocks")))
        fields = F.collect_list(F.struct("class", "label", "n", "bands", "text", "minor"))
        return split.groupBy("band", "key", "__block").agg(fields.alias(tag)).drop("__block")

    everyone = packed(full, active, block, "all")
    minors = packed(full.filter("minor"), active.filter("minor"), 64, "few")
    pairs = minors.join(everyone, ["band", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow columns are read in place: of a batch of many large blocks only one row's texts become Python objects
        known: dict[bytes, int] = {}

        def opened(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
            plain = [rows.field(name).to_numpy(zero_copy_only=False) for name in ("class", "label", "n", "minor")]
            return *plain, rows.field("bands").flatten().to_numpy().reshape(-1, BANDS).view(np.uint16), rows.field("text")

        for batch in batches:
            found: list[tuple[int, int]] = []
            for at_row, band in enumerate(batch.column(0).to_pylist()):
                class_one, label_one, n_one, _, one, text_one = opened(batch.column(1)[at_row].values)
                class_two, label_two, n_two, minor_two, two, text_two = opened(batch.column(2)[at_row].values)
                keys_one, keys_two = one.view(np.int64), two.view(np.int64)
                sets: dict[int, np.ndarray] = {}
                for at in range(len(class_one)):
                    mine = int(class_one[at])
                    other = label_two != label_one[at]
                    # both minor: the pair is looked at once, from its smaller class
                    other &= ~minor_two.astype(bool) | (class_two > mine)
                    if band:
                        other &= ~(keys_two[:, :band] == keys_one[at, :band]).any(axis=1)
                    equal = (two == one[at]).sum(axis=1)
                    other &= estimates(equal, np.full(len(class_two), float(n_one[at])), n_two.astype(float)) >= least
                    for place in np.flatnonzero(other):
                        theirs = int(class_two[place])
                        for name, texts_of, where in ((mine, text_one, at), (theirs, text_two, int(place))):
                            if name not in sets:
                                sets[name] = shingle_set(texts_of[where].as_py(), size, known)
                        if _linked(sets[mine], sets[theirs], percent):
                            found.append((mine, theirs))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return pairs.select("band", "few", "all").mapInArrow(search, "a long, b long")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, least: float = 0.55, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, id, n (shingles) and ``group`` of every row; rows that a chain of links joins share a group.

    Rows with equal sets are one class, compared once. Classes that agree in a band of four registers are
    candidates (a pair at the threshold meets in no band with probability 5e-8). Each is first checked with
    one member per band, then what is still in different components of a bucket is compared in full, so a
    bucket of any size costs about its size, and no link between components goes unseen. Pairs estimated
    under ``least`` (seven standard errors below the threshold) are not checked.

    Null and empty texts have no shingles and a group of their own (null). Repeated rows and null ids are
    ordinary members. An empty table gives no rows.
    """
    keyed = with_row_key(docs)
    signed = stored(signatures(keyed, size, id_col, text_col))
    first = F.min(F.struct(*ROW_KEY))
    classes = signed.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(first.alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.select("fingerprint", "row.*", "n", "bands", F.monotonically_increasing_id().alias("class")))

    masks = F.array(*[F.lit(mask) for mask in _MASKS])
    keys = classes.select("class", F.posexplode("bands").alias("band", "key"))
    veiled = F.col("class").bitwiseXOR(F.element_at(masks, F.col("band") + 1))  # another order of the classes in each band
    buckets = keys.withColumn("veiled", veiled).groupBy("band", "key").agg(F.min("veiled").alias("veiled"), F.count("*").alias("rows"))
    buckets = buckets.filter("rows > 1").select("band", "key", F.col("veiled").bitwiseXOR(F.element_at(masks, F.col("band") + 1)).alias("first"))
    buckets = stored(buckets)
    shared = mark_members(keys, membership_bitmap(buckets, ["band", "key"]), ["band", "key"], "__shared").filter("__shared").drop("__shared")
    members = stored(shared.join(buckets, ["band", "key"]))

    stars = members.filter("class <> first").groupBy(F.col("class").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("__bands")).drop("__bands")
    stars = stored(estimated(stars, classes).filter(F.col("estimate") >= least))
    wanted = stored(members.select("class").distinct().join(classes.select("class", *ROW_KEY), "class"))
    source = keyed.select(*ROW_KEY, text_of(text_col).alias("text"))
    texts = mark_members(source, membership_bitmap(wanted, ROW_KEY), ROW_KEY, "__wanted").filter("__wanted").drop("__wanted")
    texts = stored(texts.join(wanted, ROW_KEY).select("class", "text"))

    order = Window.partitionBy("a").orderBy(F.desc("estimate"), "b")
    best = stored(stars.withColumn("__at", F.row_number().over(order)))
    links = stored(confirmed(best.filter("__at <= 2"), texts, size, percent))
    labels = components(links)
    rest = different(best.filter("__at > 2"), labels)
    links = stored(links.unionByName(confirmed(rest, texts, size, percent)))
    labels = components(links)
    links = stored(links.unionByName(across(members, labels, classes, texts, size, percent, least)))
    labels = components(links)

    grouped = classes.select("fingerprint", "class").join(labels.withColumnRenamed("node", "class"), "class", "left")
    grouped = stored(grouped.select("fingerprint", F.coalesce("label", "class").alias("group")))
    full = signed.filter("fingerprint IS NOT NULL").join(grouped, "fingerprint").select(*ROW_KEY, "id", "n", "group")
    return stored(full.unionByName(signed.filter("fingerprint IS NULL").select(*ROW_KEY, "id", "n", F.lit(None).cast("long").alias("group"))))


def different(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    side = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"__{name}"))
    joined = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.filter(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b")


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id (null ids last, then the first row) of each group; rows without words all stay."""
    keyed = with_row_key(docs)
    found = near_components(keyed, size, percent, id_col=id_col, text_col=text_col)
    grouped = found.filter("group IS NOT NULL")
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), *ROW_KEY)
    firsts = stored(grouped.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
                    .select("group", *[F.col(f"first.{key}").alias(f"first{key}") for key in ROW_KEY]))
    same = F.lit(True)
    for key in ROW_KEY:
        same = same & (F.col(key) == F.col(f"first{key}"))
    return without_rows(keyed, grouped.join(firsts, "group").filter(~same).select(*ROW_KEY))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), size=4, percent=80)
    smallest = stored(found.filter("group IS NOT NULL").groupBy("group").agg(F.min("id").alias("component_id")))
    columns = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")]
    joined = found.filter("group IS NOT NULL").join(smallest, "group").select(*columns)
    return joined.unionByName(found.filter("group IS NULL").withColumn("component_id", F.col("id")).select(*columns))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE: dict[str, str] = {}

"""Filter interaction audit: a sparse document-term matrix in CSR shards tells which documents fail which filters."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from rulegrain.llm.common import stored, table, text_of

SHARD_BYTES = 8_000_000  # text of one matrix shard; a longer document is a shard of its own
# The five filters and their limits.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MARKS = re.compile(r"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
BIT = {letter: 1 << at for at, letter in enumerate(LETTERS)}

_SHARD = "shard long, parts array<string>, digests array<binary>, flags array<int>, bounds array<int>, columns binary, counts binary"
_SEED, _MOST = 42, (1 << 63) - 1  # a term is its word's XXH64 without the sign; negative numbers are left for words that share one


class _Places(dict):
    """Numbers words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def local_shards(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """CSR shards of about ``SHARD_BYTES`` of text whose columns count in the shard's own ``words``, by first appearance."""

    def build(shard: int, rows: list[tuple]) -> pd.DataFrame:
        place = _Places()
        bounds, columns, counts, digests, flags = [0], [], [], [], []
        for _, _, text, data in rows:
            found = Counter(data.split())
            columns.append(np.fromiter(map(place.__getitem__, found), dtype=np.int32, count=len(found)))
            counts.append(np.fromiter(found.values(), dtype=np.int32, count=len(found)))
            bounds.append(bounds[-1] + len(found))
            digests.append(hashlib.blake2b(data, digest_size=16).digest())
            capitals = len(data) - len(data.translate(None, CAPITALS))
            flags.append(BIT["C"] * (100 * capitals > MOST_CAPITALS * len(text)) + BIT["D"] * (MARKS.search(text) is not None))
        joined = lambda parts: np.concatenate(parts).tobytes()
        return pd.DataFrame({
            "shard": [shard], "ids": [[row[0] for row in rows]], "parts": [[row[1] for row in rows]], "digests": [digests], "flags": [flags],
            "bounds": [bounds], "columns": [joined(columns)], "counts": [joined(counts)], "words": [list(place)]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, rows, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for row in zip(batch["id"], batch["part"], batch["text"], strict=True):
                rows.append((*row, row[2].encode("utf-8", "surrogatepass")))
                size += len(rows[-1][3])
                if size >= SHARD_BYTES or len(rows) >= 200_000:
                    yield build(shard, rows)
                    shard, rows, size = shard + 1, [], 0
        if rows:
            yield build(shard, rows)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(part_col).alias("part"), text_of(text_col).alias("text"))
    return rows.mapInPandas(cut, f"{_SHARD}, ids array<string>, words array<binary>")  # ids as text, so ids beside nulls stay exact


def term_of(word: str | Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(_MOST))


def shared_terms(local: DataFrame) -> dict[bytes, int]:
    """Words whose hash another word of the corpus has too, with the negative terms they get instead (none below some 10**9 words).

    Of each hash only the least and greatest of a second hash travel; the words themselves are read again where these differ.
    """
    words = local.select(F.explode("words").alias("word"))
    spread = words.select(term_of("word").alias("term"), F.hash("word").alias("check")).groupBy("term").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = stored(spread.filter("low <> high").select("term"))
    if shared.isEmpty():
        return {}
    if shared.count() > 100_000:
        raise ValueError("too many words share a 64-bit hash: the words are made for it")
    found = words.withColumn("term", term_of("word")).join(F.broadcast(shared), "term").select("word").distinct()  # the bound is checked above
    return {bytes(row["word"]): -1 - at for at, row in enumerate(found.orderBy("word").collect())}


def encoded(words: list[bytes], columns: bytes, counts: bytes, shared: dict[bytes, int], most: int = _MOST) -> tuple[np.ndarray, np.ndarray]:
    """Terms and counts of a shard's rows by the global dictionary."""
    digest = xxhash.xxh64_intdigest
    terms = np.fromiter((digest(word, _SEED) & most for word in words), dtype=np.int64, count=len(words))
    if shared:
        terms = np.array([shared.get(word, term) for word, term in zip(words, terms.tolist(), strict=True)], dtype=np.int64)
    if len(np.unique(terms)) < len(terms):  # cannot be once words that share a hash have terms of their own
        raise ValueError("two words of a shard have one term")
    return terms[np.frombuffer(columns, dtype=np.int32)], np.frombuffer(counts, dtype=np.int32)


def term_matrix(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The dictionary (``word``, ``term``) of all distinct words, and the CSR shards over it.

    A shard row holds, for its documents in order, ``ids``, ``parts`` (null: empty), ``digests`` (blake2b of the text) and ``flags``
    (bits of filters C and D), the row bounds, and int64 terms and int32 counts as bytes, ascending in a row. A term is its word's hash,
    checked over the whole corpus to be that of no other word, so shards need no join with the dictionary.
    Words are maximal runs without ASCII white space, case-sensitive; null texts are empty rows.
    """
    local = stored(local_shards(docs, id_col, part_col, text_col))
    shared = shared_terms(local)
    term = term_of("word")
    for word, other in shared.items():
        term = F.when(F.col("word") == F.lit(bytearray(word)), other).otherwise(term)
    dictionary = local.select(F.explode("words").alias("word")).distinct().select(F.col("word").cast("string").alias("word"), term.alias("term"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.iloc[at:at + 1]
                terms, counts = encoded(*(row[name].iat[0] for name in ("words", "columns", "counts")), shared, _MOST)
                sizes = np.diff(np.asarray(row["bounds"].iat[0]))
                order = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
                yield row.drop(columns="words").assign(columns=[terms[order].tobytes()], counts=[counts[order].tobytes()])

    kept = local.drop("words")
    shards = local.mapInPandas(encode, kept.schema)
    return dictionary, shards.withColumn("ids", F.col("ids").cast(ArrayType(docs.schema[id_col].dataType)))


def failed(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id``, ``part``, ``digest``, ``n_words`` (row sum), ``n_distinct`` (nonzero columns) and ``flags`` (bits of A to D) of every document."""
    local = stored(local_shards(docs, id_col, part_col, text_col))
    shared = shared_terms(local)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch.itertuples():
                _, counts = encoded(shard.words, shard.columns, shard.counts, shared, _MOST)
                bounds = np.asarray(shard.bounds)
                n_words = np.diff(np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[bounds])
                n_distinct = np.diff(bounds)  # no term stands twice in a row
                flags = np.asarray(shard.flags) + BIT["A"] * (n_words < LEAST_WORDS) + BIT["B"] * (100 * n_distinct < LEAST_DISTINCT * n_words)
                yield pd.DataFrame({"id": list(shard.ids), "part": list(shard.parts), "digest": list(shard.digests), "n_words": n_words, "n_distinct": n_distinct, "flags": flags})

    rows = local.mapInPandas(read, "id string, part string, digest binary, n_words long, n_distinct long, flags int")
    return rows.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def patterns(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per part and set of failed filters (``pattern``, bits of A to E): documents ``n``, and those labelled good and toxic.

    E fails rows whose text stands under a smaller id; rows of equal id do not fail each other and null ids never fail.
    Rows are counted by (digest, id) before groups of copies meet, so a group of any size arrives as a few rows a part.
    """
    one = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = documents.join(known, "id", "left").fillna(0, ["good", "toxic"])
    same = ["digest", "part", "flags", "good", "toxic"]
    by_id = rows.groupBy(*same, "id").count()
    low = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "count"))).alias("low")
    groups = by_id.groupBy(*same).agg(
        F.sum("count").alias("n"), low, F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("count"))), F.lit(0)).alias("unnamed"))
    groups = groups.withColumn("least", F.min("low.id").over(Window.partitionBy("digest")))
    passing = F.col("unnamed") + F.when(F.col("low.id") == F.col("least"), F.col("low.count")).otherwise(0)
    both = F.array(
        F.struct(F.col("flags").alias("pattern"), passing.alias("n")),
        F.struct(F.col("flags").bitwiseOR(F.lit(BIT["E"])).alias("pattern"), (F.col("n") - passing).alias("n")))
    parted = groups.select("part", "good", "toxic", F.explode(both).alias("to")).select("part", "good", "toxic", "to.*")
    return parted.groupBy("part", "pattern").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def steps() -> list[dict]:
    """Every order of the filters with, for each step, the filter's bit and the bits of those before it."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            out.append({"filter_order": "".join(order), "step": step, "bit": BIT[letter], "before": before})
            before |= BIT[letter]
    return out


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of :func:`patterns`: at most 32 of them a part, whatever the corpus."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("__patterns"))
    each = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = parts.select("part", "__patterns", F.explode(each).alias("__at")).select("part", "__patterns", "__at.*")

    def total(alias: str, wanted, value: str = "n", weight=lambda pattern: F.lit(1)) -> Column:
        def add(sum_, p: Column) -> Column:
            return sum_ + F.when(wanted(p["pattern"]), p[value] * weight(p["pattern"])).otherwise(F.lit(0))

        return F.aggregate("__patterns", F.lit(0).cast("long"), lambda sum_, p: add(sum_, p).cast("long")).alias(alias)

    bit, before = F.col("bit"), F.col("before")
    fails = lambda p: p.bitwiseAND(bit) != 0
    open_ = lambda p: p.bitwiseAND(before) == 0
    removed = lambda p: fails(p) & open_(p)
    # among the orders, each of a document's k failed filters comes first equally often
    orders = lambda p: (F.lit(120) / F.bit_count(p)).cast("long")
    return rows.select(
        "part", "filter_order", "step", total("kept", lambda p: ~fails(p) & open_(p)), total("removed", removed),
        total("redundant", lambda p: fails(p) & ~open_(p)), total("unique_fails", lambda p: p == bit),
        total("good_lost", removed, "good"), total("toxic_lost", removed, "toxic"), total("shapley", fails, weight=orders))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """What each of the five filters does in each order, per part (null: empty string), over whole texts.

    Null texts are empty; empty texts fail A alone unless copies. Repeated rows count each; repeated labels count as marked once any
    of them is; an empty table gives no rows; other columns play no part.
    """
    return interactions(patterns(failed(docs, id_col, part_col, text_col), labels, id_col))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE: dict[str, str] = {"op12_filter_audit": r"""
WITH known AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), split AS (
    SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS least FROM texts
), marked AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS pattern
    FROM split LEFT JOIN known USING (doc_id)
), counted AS (
    SELECT part, pattern, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, pattern
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, l.letter, l.bit, (SELECT coalesce(sum(x.bit), 0)::INTEGER FROM letters x WHERE strpos(filter_order, x.letter) < step) AS before
    FROM orders, range(1, 6) r(step), letters l WHERE l.letter = filter_order[step::INTEGER]
), done AS (
    SELECT part, filter_order, step, letter,
        sum(CASE WHEN pattern & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN pattern & bit <> 0 AND pattern & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN pattern & bit <> 0 AND pattern & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN pattern = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN pattern & bit <> 0 AND pattern & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN pattern & bit <> 0 AND pattern & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM done
"""}

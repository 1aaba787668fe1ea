"""Substring dedup by line hashing: equal normalised units keep their earliest occurrence."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from rulegrain.llm.common import ROW_KEY, mark_members, membership_bitmap, stored, table, text_of, with_row_key

_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s)|$)", re.S)
_WORD = re.compile(r"\w+")


def units(text: str, by_sentence: bool) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, stop, words, digest) of each line, cut at sentence ends if asked; digests ignore case, punctuation and spacing."""
    for line in _LINE.finditer(text):
        for part in _SENTENCE.finditer(line.group()) if by_sentence else [re.match(r".*", line.group(), re.S)]:
            words = _WORD.findall(part.group().lower())
            if words:
                lead = len(part.group()) - len(part.group().lstrip())
                start = line.start() + part.start() + lead
                yield start, line.start() + part.start() + len(part.group().rstrip()), len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unit_rows(docs: DataFrame, by_sentence: bool, id_col: str, text_col: str) -> DataFrame:
    rows = with_row_key(docs).select(*ROW_KEY, F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    columns = [*ROW_KEY, "id", "unit", "start", "stop", "words", "digest"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for file, at, name, text in zip(*(batch[c] for c in (*ROW_KEY, "id", "text")), strict=True):
                out += [(file, at, name, number, *unit) for number, unit in enumerate(units(text, by_sentence))]
                if len(out) - size > 50_000:
                    yield pd.DataFrame(out, columns=columns).astype({"id": batch["id"].dtype})
                    out = []
            yield pd.DataFrame(out, columns=columns).astype({"id": batch["id"].dtype})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(cut, f"{ROW_KEY[0]} long, {ROW_KEY[1]} long, id {kind}, unit int, start int, stop int, words int, digest binary")


def _lost_units(docs: DataFrame, by_sentence: bool, id_col: str, text_col: str) -> DataFrame:
    """The units of :func:`repeated_units` with the row and unit number that are kept.

    Units rank by id (null last), then row, then offset. Digests are counted with a partial sum in the map
    tasks; only units whose digest occurs again, told by a fixed-size bitmap, are shuffled a second time.
    Null and empty texts have no units; repeated rows repeat each other; an empty table gives no rows.
    """
    found = unit_rows(docs, by_sentence, id_col, text_col)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", *ROW_KEY, "start", "unit")
    groups = stored(found.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).filter("copies > 1"))
    firsts = groups.select("digest", F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"), F.col("first.unit").alias("kept_unit"),
                           F.col(f"first.{ROW_KEY[0]}").alias("kept_file"), F.col(f"first.{ROW_KEY[1]}").alias("kept_at"))
    again = mark_members(found, membership_bitmap(firsts, ["digest"]), ["digest"], "__again").filter("__again").drop("__again")
    is_first = (F.col(ROW_KEY[0]) == F.col("kept_file")) & (F.col(ROW_KEY[1]) == F.col("kept_at")) & (F.col("start") == F.col("kept_start"))
    return again.join(firsts, "digest").filter(~is_first)


def repeated_units(docs: DataFrame, by_sentence: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every unit that is not the first of its digest, with its offsets and the place that is kept."""
    return _lost_units(docs, by_sentence, id_col, text_col).drop("kept_file", "kept_at", "kept_unit")


def repeated_runs(docs: DataFrame, least_words: int = 20, least_unit: int = 6, by_sentence: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All repeated units, neighbouring ones as one run in original offsets, and whether dedup cuts the run.

    A run of ``least_words`` words is cut if that many of its words, or half of them, are no chance repeats: units of
    ``least_unit`` words, and shorter ones that with others of the run stand in the same order in one kept row.
    ``kept_ids`` lists the documents that keep the run's units.
    """
    lost = stored(_lost_units(docs, by_sentence, id_col, text_col))
    runs = lost.withColumn("__run", F.col("unit") - F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("unit")))
    kept_together = F.count("*").over(Window.partitionBy(*ROW_KEY, "__run", "kept_file", "kept_at", F.col("kept_unit") - F.col("unit")))
    sure = (F.col("words") >= least_unit) | (F.col("__together") > 1)
    return (
        runs.withColumn("__together", kept_together).groupBy(*ROW_KEY, "__run")
        .agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_units"),
             F.sum("words").alias("n_words"), F.sum(F.when(sure, F.col("words")).otherwise(0)).alias("__sure"), F.array_sort(F.collect_set("kept_id")).alias("kept_ids"))
        .withColumn("cut", (F.col("n_words") >= least_words) & ((F.col("__sure") >= least_words) | (2 * F.col("__sure") >= F.col("n_words"))))
        .drop("__run", "__sure")
    )


def repeated_stretches(docs: DataFrame, least_words: int = 20, least_unit: int = 6, by_sentence: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs that dedup removes; others, such as a licence line, stay in the text."""
    return repeated_runs(docs, least_words, least_unit, by_sentence, id_col, text_col).filter("cut").drop("cut")


def without_repeats(docs: DataFrame, least_words: int = 20, least_unit: int = 6, by_sentence: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed stretches cut out of the text; all other columns and rows stay."""
    keyed = with_row_key(docs)
    cuts = repeated_stretches(keyed, least_words, least_unit, by_sentence, id_col, text_col)
    cuts = stored(cuts.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cuts")))

    @pandas_udf("string")
    def remove(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(texts, spans, strict=True):
            parts, at = [], 0
            for span in cut:
                parts.append(text[at:span["start"]])
                at = span["stop"]
            out.append("".join(parts) + text[at:])
        return pd.Series(out)

    flagged = mark_members(keyed, membership_bitmap(cuts, ROW_KEY), ROW_KEY, "__cut")
    columns = docs.columns
    touched = flagged.filter("__cut").join(cuts, ROW_KEY, "left")
    hit = touched.filter("__cuts IS NOT NULL").withColumn(text_col, remove(text_col, "__cuts")).select(*columns)
    missed = touched.filter("__cuts IS NULL").select(*columns)
    return flagged.filter("NOT __cut").select(*columns).unionByName(missed).unionByName(hit)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_runs(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "stop", "n_units", "n_words", "kept_ids", "cut")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE: dict[str, str] = {}

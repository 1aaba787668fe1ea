"""Reading tables: formats, encodings, null handling, catalogs."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.functions.text import any_word_pattern, strip
from rulegrain.operators.taxonomy import scene_name_tokens, to_string_list

STEP = 1 << 20  # bytes tried at once
ROWS = 10_000  # rows passed on at once


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text behind one call; :func:`read_csv` is for files whose encoding is not known."""
    reader = spark.read.format(fmt).options(**{**({"header": "true"} if fmt == "csv" else {}), **options})
    return (reader.schema(schema) if schema else reader).load(path)


def read_csv(spark: SparkSession, path: str, columns: Iterable[str], encodings: Iterable[str] = ("utf-8-sig", "gb18030"), pattern: str = "*.csv") -> DataFrame:
    """CSV files with a header row, each in the first of the encodings that reads it without fault (A2); all columns are text.

    UTF-8 goes first: text of another encoding is hardly ever valid in it, while gb18030 reads much UTF-8 as other characters.
    A file is held as bytes, decoded and passed on in parts; a column that a file lacks is empty, one that is not named is left out. Only a file that
    none of the encodings fits raises an error.
    """
    names, known = list(columns), list(encodings)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, content in zip(batch["path"], batch["content"], strict=True):
                for at, encoding in enumerate(known):
                    try:
                        for _ in codecs.iterdecode((content[start : start + STEP] for start in range(0, len(content), STEP)), encoding):
                            pass
                        break
                    except UnicodeDecodeError:
                        if at + 1 == len(known):
                            raise ValueError(f"{place} is in none of {known}") from None
                rows = csv.DictReader(io.TextIOWrapper(io.BytesIO(content), encoding, newline=""))
                while part := [[row.get(name) or "" for name in names] for row in itertools.islice(rows, ROWS)]:
                    yield pd.DataFrame(part, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(parse, ", ".join(f"`{name}` string" for name in names))


def read_atoms(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Atom table with null text read as empty (A1)."""
    return read_table(spark, path, fmt, **options).na.fill("")


def scalar_rows(rows: DataFrame) -> DataFrame:
    """Strings trimmed, NaN to null (A5)."""
    kinds = dict(rows.dtypes)

    def clean(name: str):
        column = F.col(f"`{name}`")
        if kinds[name] == "string":
            return F.when(column.isNotNull(), strip(column)).alias(name)
        if kinds[name] in ("double", "float"):
            return F.when(~F.isnan(column), column).alias(name)
        return column

    return rows.select(*[clean(name) for name in rows.columns])


def read_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Modules, scenes and metadata; scenes without terms get those of their name."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("modules", "scenes", "metadata")}
    scenes = tables["scenes"]
    kind = dict(scenes.dtypes)["scene_terms"]
    terms = F.col("scene_terms") if kind.startswith("array") else to_string_list("scene_terms")
    tables["scenes"] = scenes.withColumn("scene_terms", F.when(F.size(terms) > 0, terms).otherwise(scene_name_tokens("scene_name")))
    return tables


def documents_named(documents: DataFrame, name: str, keywords: Iterable[str]) -> DataFrame:
    """Documents whose name has one of the keywords; office lock files are skipped."""
    return documents.filter(F.col(name).rlike(any_word_pattern(keywords)) & ~F.startswith(F.col(name), F.lit("~$"))).orderBy(name)

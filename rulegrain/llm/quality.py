"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from rulegrain.llm.common import fold_of, table, text_of

STATISTICS = [
    "words", "word_length", "symbols", "odd_ends", "repeats", "distinct", "common", "shouted", "digits", "bare_symbols", "lines", "stops", "longest",
]
_ODD = re.compile(r"[^\w\s.,;:'\"?()-]")
_ODD_END = re.compile(r"[^\w\s.,;:'\")]{2,}(?=\s|$)")
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"[.!?](?=\s|$)")
_CAPITALS = re.compile(r"(?<!\w)[^\W\d_a-zà-öø-ÿ]{2,}(?!\w)")


def statistics(text: str | None) -> list[float]:
    """Log-scaled shares and sizes of one whole text, in the order of ``STATISTICS``; null counts as empty."""
    text = text or ""
    words = text.split()
    size = len(words)
    counts = Counter(words)
    letters = sum(map(len, words))
    share = lambda count, of: float(np.log(0.01 + count / (of + 5.0)))
    return [
        float(np.log1p(size)),
        float(np.log((letters + 25.0) / (size + 5.0))),
        share(len(_ODD.findall(text)), letters),
        share(len(_ODD_END.findall(text)), size),
        share(sum(map(str.__eq__, words, words[1:])), size),
        float(np.log((len(counts) + 5.0) / (size + 5.0))),
        share(max(counts.values(), default=1) - 1, size),
        share(len(_CAPITALS.findall(text)), size),
        share(len(_DIGIT.findall(text)), letters),
        share(sum(n for word, n in counts.items() if not any(map(str.isalnum, word))), size),
        share(text.count("\n"), size),
        share(len(_STOP.findall(text)), size),
        float(np.log1p(max(map(len, counts), default=0))),
    ]


@dataclass
class QuadraticDiscriminant:
    """Class means and cached Cholesky factors in standardised space."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    prior: float = 0.5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the difference of the two Mahalanobis log densities."""
        if not self.means:
            return np.full(len(rows), self.prior)
        rows = (rows - self.centre) / self.scale
        density = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            white = np.linalg.solve(factor, (rows - mean).T)
            density.append(offset - 0.5 * (white * white).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, pool: float) -> QuadraticDiscriminant:
    """From each class's count, sums and sums of products. A class without rows leaves a constant score."""
    width = len(STATISTICS)
    total = sum(count for count, _, _ in moments.values())
    present = [label for label in (0, 1) if moments.get(label, (0,))[0] > 0]
    if len(present) < 2:
        prior = 0.5 if not present else 0.5 + 0.5 * (present[0] * 2 - 1)
        return QuadraticDiscriminant(np.zeros(width), np.ones(width), [], [], [], prior)
    centre = sum(sums for _, sums, _ in moments.values()) / total
    spread = sum(np.diag(products) for _, _, products in moments.values()) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, covariances, counts = [], [], []
    for label in (0, 1):
        count, sums, products = moments[label]
        mean = (sums / count - centre) / scale
        raw = products / count - np.outer(sums / count, sums / count)
        means.append(mean)
        covariances.append(raw / np.outer(scale, scale))
        counts.append(count)
    pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / total
    factors, offsets = [], []
    for count, covariance in zip(counts, covariances, strict=True):
        mixed = (1 - pool) * covariance + pool * pooled
        mixed = (1 - shrink) * mixed + shrink * np.eye(width) * np.trace(mixed) / width + 1e-6 * np.eye(width)
        factor = np.linalg.cholesky(mixed)
        factors.append(factor)
        offsets.append(float(np.log(count / total) - np.log(np.diag(factor)).sum()))
    return QuadraticDiscriminant(centre, scale, means, factors, offsets)


def fit(docs: DataFrame, labels: DataFrame, shrink: float = 0.05, pool: float = 0.02, most: int = 50_000, folds: int = 4, held_out: int = 2,
        id_col: str = "doc_id", text_col: str = "text") -> QuadraticDiscriminant:
    """Fit on at most ``most`` labels outside the held-out fold (lowest id hashes); only class moments reach the driver (2 x 13 x 14 numbers).

    The bound keeps the sample's ids small enough to broadcast, so that no text is shuffled. Labels other than 0 and 1,
    null ids and null labels are ignored; a document labelled both ways counts once in each.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold_of(id_col, folds) != held_out)).distinct()
        .orderBy(F.xxhash64("id", F.lit("quality")), "id", "label").limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(known), "id").select("label", "text")
    width = len(STATISTICS)
    rows, columns = np.triu_indices(width + 1)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for batch in batches:
            facts = np.array([[1.0, *statistics(text)] for text in batch["text"]]).reshape(len(batch), width + 1)
            for label in (0, 1):
                mine = facts[(batch["label"] == label).to_numpy()]
                total[label] = total.get(label, 0) + mine.T @ mine
        for label, matrix in total.items():
            yield pd.DataFrame({"label": label, "row": rows, "col": columns, "value": np.asarray(matrix)[rows, columns]})

    summed = (
        texts.mapInPandas(moments, "label int, row int, col int, value double")
        .groupBy("label", "row", "col").agg(F.sum("value").alias("value")).collect()
    )
    gathered: dict[int, tuple] = {}
    for label in (0, 1):
        matrix = np.zeros((width + 1, width + 1))
        for item in summed:
            if item["label"] == label:
                matrix[item["row"], item["col"]] = matrix[item["col"], item["row"]] = item["value"]
        gathered[label] = (matrix[0, 0], matrix[0, 1:], matrix[1:, 1:])
    return discriminant(gathered, shrink, pool)


def scored(docs: DataFrame, model: QuadraticDiscriminant, text_col: str = "text", score: str = "score") -> DataFrame:
    """Add a score to every row; null and empty texts are scored by their (empty) statistics."""

    @pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(text) for text in texts]).reshape(len(texts), len(STATISTICS))))

    return docs.withColumn(score, quality(text_of(text_col)))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, fit_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` without those that score under ``least``, all columns as they were."""
    model = fit(fit_docs if fit_docs is not None else docs, labels)
    return scored(docs, model, score="__quality").filter(F.col("__quality") >= least).drop("__quality")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}

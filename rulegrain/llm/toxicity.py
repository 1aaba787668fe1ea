"""Toxicity: non-negative positive-unlabelled learning of a numpy classifier over word presence."""

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

_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6)  # letters


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text and their beginnings, marked by a star, or by two where words of the text begin so twice or more.

    A coined beginning turns up once in many long texts by chance; its return tells more than its presence.
    """
    counts = Counter(_WORD.findall((text or "").lower()))
    begins: Counter[str] = Counter()
    for word, times in counts.items():
        for size in _BEGINNINGS:
            if len(word) > size:
                begins[word[:size] + "*"] += times
    return counts.keys() | begins.keys() | {begin + "*" for begin, times in begins.items() if times > 1}


@dataclass
class PresenceModel:
    """Linear model over presence of chosen words."""

    weights: dict[str, float]
    bias: float

    def scores(self, texts) -> np.ndarray:
        raw = np.array([self.bias + sum(self.weights[word] for word in words_of(text) & self.weights.keys()) for text in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -700, 700)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 400, batch: int = 16_384, rate: float = 0.05,
          decay: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Minimise the non-negative PU risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  with logistic loss and Adam.

    Where the corrected negative part falls below zero, the step climbs it instead, as the estimator asks.
    """
    random = np.random.default_rng(seed)
    width = positive.shape[1]
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = random.permutation(len(unlabelled))
        for start in range(0, len(order), batch):
            u = unlabelled[order[start:start + batch]].astype(np.float64)
            p = positive[random.permutation(len(positive))[:batch]].astype(np.float64)
            up, uu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
            chance_p, chance_u = 1 / (1 + np.exp(-up)), 1 / (1 + np.exp(-uu))
            negative = np.logaddexp(0, uu).mean() - prior * np.logaddexp(0, up).mean()
            pull_u, pull_p = chance_u / len(u), prior * chance_p / len(p)
            if negative >= 0:
                on_p, on_u = prior * (chance_p - 1) / len(p) - pull_p, pull_u
            else:
                on_p, on_u = pull_p, -pull_u
            slope = np.append(p.T @ on_p + u.T @ on_u, on_p.sum() + on_u.sum())
            slope[:-1] += decay * theta[:-1]
            step += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = 3000, unlabelled: int = 12_000, vocabulary: int = 256,
        least_odds: float = 0.7, least_texts: int = 4, least_errors: float = 4.5, default_prior: float = 0.1, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> PresenceModel:
    """Train on at most ``positives`` confirmed toxic and ``unlabelled`` texts outside the held-out fold (lowest id hashes).

    Unlabelled texts are drawn from all documents whatever their label, so they follow the mixture that the
    estimator assumes; negative labels serve only for the class prior (``default_prior`` where there are none).
    Words are chosen by the smoothed log odds of their document shares in the two samples: ``least_odds`` or more,
    ``least_errors`` standard errors above none or more, in at least ``least_texts`` toxic texts. Without a positive text
    the score is the prior for every document. Null ids and null labels are ignored.
    """
    usable = F.col("id").isNotNull() & (fold_of("id", folds) != held_out)
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(usable & F.col("toxic").isin(0, 1))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).first()
    toxic, rows = counts["toxic"] or 0, counts["rows"]
    prior = min(0.9, max(0.001, toxic / rows)) if 0 < toxic < rows else default_prior
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    lot = F.xxhash64("id", F.lit("pu"))
    chosen = known.filter("toxic = 1").orderBy(lot, "id").limit(positives).select("id", F.lit(True).alias("positive")).unionByName(
        texts.filter(usable).select("id").orderBy(lot, "id").limit(unlabelled).select("id", F.lit(False).alias("positive")))
    sample = texts.join(F.broadcast(chosen), "id").select("positive", "text")  # at most positives + unlabelled ids

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for positive, text in zip(batch["positive"], batch["text"], strict=True):
                if words := sorted(words_of(text)):
                    yield pd.DataFrame({"word": words, "positive": bool(positive)})

    sizes = sample.agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")).first()
    if not sizes["p"] or not sizes["u"]:
        return PresenceModel({}, float(np.log(prior / (1 - prior))))
    in_p, in_u = F.count(F.when(F.col("positive"), 1)), F.count(F.when(~F.col("positive"), 1))
    shares = (
        sample.mapInPandas(seen, "word string, positive boolean").groupBy("word").agg(in_p.alias("p"), in_u.alias("u")).filter(F.col("p") >= least_texts)
        .withColumn("odds", F.log((F.col("p") + 0.5) / (sizes["p"] + 1)) - F.log((F.col("u") + 0.5) / (sizes["u"] + 1)))
        .withColumn("errors", F.col("odds") / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5)))
        .filter((F.col("odds") >= least_odds) & (F.col("errors") >= least_errors))
    )
    vocabulary_words = [row["word"] for row in shares.orderBy(F.desc("errors"), "word").limit(vocabulary).collect()]
    place = {word: at for at, word in enumerate(vocabulary_words)}

    @pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(place[word] for word in words_of(text) & place.keys()) for text in texts])

    rows = sample.select("positive", places("text").alias("places")).collect()  # bounded sample, short index lists

    def matrix(positive: bool) -> np.ndarray:
        mine = [row["places"] for row in rows if row["positive"] == positive]
        out = np.zeros((len(mine), len(place)), dtype=np.float32)
        for at, found in enumerate(sorted(mine)):
            out[at, found] = 1
        return out

    weights, bias = nn_pu(matrix(True), matrix(False), prior)
    return PresenceModel({word: float(weights[at]) for word, at in place.items()}, bias)


def scored(docs: DataFrame, model: PresenceModel, text_col: str = "text", score: str = "score") -> DataFrame:
    """Add a score to every row; texts without a chosen word, empty and null ones among them, get the model's base score."""

    @pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    return docs.withColumn(score, toxicity(text_of(text_col)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}

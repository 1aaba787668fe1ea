"""Extraction quality: summaries, samples for review, review metrics, similarity funnel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import is_true, strip, text
from rulegrain.operators.scale import broadcast_if_small, top_rows
from rulegrain.session import cut_lineage


# ------------------------------------------------------------------ summaries
def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.countDistinct("source_document").alias("doc_count"), F.count("*").alias("chunk_count"),
        F.count_if(F.size("entities") > 0).alias("non_empty_chunk_count"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entity_total"),
    )


def atom_summary(atoms: DataFrame) -> DataFrame:
    return atoms.agg(
        F.count("*").alias("rows"), F.countDistinct("source_document").alias("doc_count"),
        F.countDistinct("rule_type").alias("rule_type_count"), F.count_if(is_true("is_ambiguous")).alias("ambiguous_count"),
    )


def label_summary(classified: DataFrame) -> DataFrame:
    labelled = F.exists("label_codes", lambda code: code != V.UNCLASSIFIED_CODE)
    base = classified.agg(F.count("*").alias("rows"), F.count_if(labelled).alias("labelled_rows"))
    modules = classified.select(F.explode("label_codes").alias("code")).filter(F.col("code") != V.UNCLASSIFIED_CODE)
    return base.join(F.broadcast(modules.agg(F.countDistinct("code").alias("module_count")))).withColumn(
        "unclassified_rows", F.col("rows") - F.col("labelled_rows")
    )


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def extraction_checklist(chunks: DataFrame, atoms: DataFrame, labels: DataFrame) -> DataFrame:
    """Checks (key, value, status) against the fixed thresholds (K18). Inputs are one-row summaries."""
    row = chunks.join(F.broadcast(atoms.select(F.col("rows").alias("atom_rows"), "rule_type_count", "ambiguous_count"))).join(
        F.broadcast(labels.select(F.col("rows").alias("label_rows"), "labelled_rows")))
    entity = ratio(F.col("non_empty_chunk_count"), F.col("chunk_count"))
    ambiguity, covered = ratio(F.col("ambiguous_count"), F.col("atom_rows")), ratio(F.col("labelled_rows"), F.col("label_rows"))
    check = lambda key, value, passed: F.struct(
        F.lit(key).alias("key"), F.coalesce(value, F.lit(0.0)).alias("value"), F.when(passed, "pass").otherwise("warn").alias("status"))
    items = F.array(
        check("extract_phase1_presence", entity, (F.col("entity_total") > 0) & (F.coalesce(entity, F.lit(0.0)) >= 0.3)),
        check("extract_atoms_presence", F.col("atom_rows").cast("double"), (F.col("atom_rows") > 0) & (F.col("rule_type_count") > 0)),
        check("extract_atoms_ambiguity", ambiguity, F.coalesce(ambiguity, F.lit(0.0)) <= 0.25),
        check("extract_classified_coverage", covered, F.coalesce(covered, F.lit(0.0)) >= 0.7),
    )
    return row.select(F.explode(items).alias("i")).select("i.*")


def graph_checklist(stats: DataFrame) -> DataFrame:
    """Graph checks over (kind, type, n) statistics."""
    n = lambda kind, name: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("type") == name), F.col("n"))), F.lit(0))
    nodes = ["board", "category", "module", "scene", "atom", "actor", "object", "time_context"]
    edges = ["TAGGED_AS", "MATCHES_SCENE", "SCENE_HAS_ACTOR", "TARGETS_OBJECT", "HAS_TIME_CONTEXT"]
    row = stats.agg(*[n("node", name).alias(name) for name in nodes], *[n("edge", name).alias(name) for name in edges])
    here = lambda *names: F.least(*[F.col(name) for name in names]) > 0 if len(names) > 1 else F.col(names[0]) > 0
    tag_ratio = F.coalesce(ratio(F.col("TAGGED_AS"), F.col("atom")), F.lit(0.0))
    check = lambda key, passed: F.struct(F.lit(key).alias("key"), F.when(passed, "pass").otherwise("warn").alias("status"))
    items = F.array(
        check("graph_nodes_presence", here("board", "category", "module", "scene", "atom")), check("graph_tag_relationships", tag_ratio >= 0.8),
        check("graph_scene_matches", here("MATCHES_SCENE")), check("graph_actor_relationships", here("actor", "SCENE_HAS_ACTOR")),
        check("graph_object_relationships", here("object", "TARGETS_OBJECT")), check("graph_time_relationships", here("time_context", "HAS_TIME_CONTEXT")),
    )
    return row.select(F.explode(items).alias("i")).select("i.*")


# ------------------------------------------------------------------ sampling
def sample_size(total: int, percent: float, minimum: int = 1, cap: int | None = None) -> int:
    if total <= 0:
        return 0
    size = max(minimum, math.ceil(total * max(percent, 0.0) / 100.0))
    return min(size if not cap else min(size, cap), total)


def diverse_sample(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """First row of each group in rank order, then the best of the rest, up to ``limit``.

    The group leaders come from a per-group top-1, the fill from a global top-n: no sort of all
    rows, and no group is gathered.
    """
    named = strip(group)
    keyed = rows.withColumn("_group", named)
    leaders = top_rows(keyed.filter(F.col("_group") != ""), ["_group"], order, 1, "_lead").orderBy(*order).limit(limit)
    leaders = leaders.drop("_lead").withColumn("_tier", F.lit(0))
    fill = keyed.orderBy(*order).limit(2 * limit).withColumn("_tier", F.lit(1))
    identity = [name for name in rows.columns]
    merged = leaders.unionByName(fill).groupBy(*identity, "_group").agg(F.min("_tier").alias("_tier"))
    return merged.orderBy("_tier", *order).limit(limit).drop("_tier", "_group")


def with_group_size(rows: DataFrame, group: str, alias: str = "group_size") -> DataFrame:
    """Rows per group on every row: a small aggregate joined back, so a hot group stays spread. Null is a group like others."""
    # stored and broadcast: a join planned before its size is known would shuffle whole rows by a handful of groups
    sizes = cut_lineage(rows.groupBy(group).agg(F.count("*").alias(alias)).withColumnRenamed(group, "_sized"))
    return rows.join(broadcast_if_small(sizes), F.col(group).eqNullSafe(F.col("_sized"))).drop("_sized")


def atom_samples(atoms: DataFrame, limit: int) -> DataFrame:
    """Typical atoms: common rule types first, clear before ambiguous, long text first."""
    scored = atoms.withColumn("ambiguous_flag", is_true("is_ambiguous")).withColumn(
        "text_score", F.length(text("what")) + F.length(text("how")) + F.length(text("content_original"))
    )
    ranked = with_group_size(scored, "rule_type")
    return diverse_sample(ranked, "rule_type", [F.desc("group_size"), F.col("ambiguous_flag"), F.desc("text_score"), F.col("atom_id")], limit)


def ambiguous_samples(atoms: DataFrame, limit: int) -> DataFrame:
    flagged = atoms.filter(is_true("is_ambiguous")).withColumn(
        "text_score", F.length(text("what")) + F.length(text("how")) + F.length(text("content_original"))
    )
    return diverse_sample(flagged, "review_reason", [F.col("review_reason"), F.desc("text_score"), F.col("atom_id")], limit)


def classified_samples(classified: DataFrame, limit: int) -> DataFrame:
    labelled = classified.filter(F.exists("label_codes", lambda code: code != V.UNCLASSIFIED_CODE))
    ranked = with_group_size(labelled.withColumn("primary_label", F.get("label_paths", F.lit(0))), "primary_label")
    return diverse_sample(ranked, "primary_label", [F.desc("group_size"), F.col("primary_label"), F.col("atom_id")], limit)


def unclassified_samples(classified: DataFrame, limit: int) -> DataFrame:
    rest = classified.filter(~F.exists("label_codes", lambda code: code != V.UNCLASSIFIED_CODE))
    return rest.orderBy("rule_type", "atom_id").limit(limit)


# ------------------------------------------------------------------ review
def review_rows(samples: DataFrame, group: str, label: str, keys: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """Review rows with an id from the key columns; earlier judgements carry over."""
    rows = samples.withColumn("sample_group", F.lit(group)).withColumn("sample_label", F.lit(label)).withColumn(
        "sample_id", F.concat_ws(" | ", *[F.nullif(strip(key), F.lit("")) for key in keys])
    )
    if earlier is None:
        return rows.withColumn("judgement", F.lit(V.REVIEW_PENDING)).withColumn("notes", F.lit(""))
    last = earlier.groupBy("sample_id").agg(F.max_by("judgement", "judged_at").alias("judgement"), F.max_by("notes", "judged_at").alias("notes"))
    return rows.join(last, "sample_id", "left").fillna({"judgement": V.REVIEW_PENDING, "notes": ""})


def review_metrics(reviews: DataFrame, by: str = "sheet_name") -> DataFrame:
    """Metrics per sheet and in total in one pass (rollup); the total row is 合计."""
    count = lambda value: F.count_if(F.col("judgement") == value)
    out = reviews.rollup(by).agg(
        F.grouping(by).alias("_total"), F.count("*").alias("rows"), count(V.REVIEW_PENDING).alias("pending"), count(V.REVIEW_PASS).alias("passed"),
        count(V.REVIEW_QUESTIONABLE).alias("questionable"), count(V.REVIEW_WRONG).alias("wrong"),
    )
    reviewed = F.col("rows") - F.col("pending")
    return (
        out.withColumn(by, F.when(F.col("_total") == 1, "合计").otherwise(F.col(by))).drop("_total")
        .withColumn("reviewed", reviewed).withColumn("issue", F.col("questionable") + F.col("wrong"))
        .withColumn("completion_rate", ratio(F.col("reviewed"), F.col("rows")))
        .withColumn("pass_review_rate", ratio(F.col("passed"), F.col("reviewed")))
    )


# ------------------------------------------------------------------ similarity
def cosine(left: str | Column, right: str | Column) -> Column:
    """Cosine of two vectors of one row; null for a zero vector."""
    left, right = (F.col(v) if isinstance(v, str) else v for v in (left, right))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value.cast("double"))
    dot = total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    size = norm(left) * norm(right)
    return F.when(size > 0, dot / size)


def reconstructed_text() -> Column:
    return F.concat_ws(" ", *[text(name) for name in ("who", "when", "where", "how", "what")])


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key: positions average separately, so a hot key merges map-side."""
    rows = vectors.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda pair: pair["x"]).alias("mean"))


def quality_status(scored: DataFrame, verdicts: DataFrame | None, key: str, low: float = V.QUALITY_LOW, high: float = V.QUALITY_HIGH) -> DataFrame:
    """Funnel: clear scores decide, the middle takes an external verdict or stays PENDING."""
    if verdicts is None:
        verdicts = scored.select(key).limit(0).withColumn("is_pass", F.lit(None).cast("boolean"))
    joined = scored.join(verdicts, key, "left")
    status = (
        F.when(F.col("score") > high, "AUTO_PASS").when(F.col("score") < low, "AUTO_FAIL")
        .when(F.col("is_pass"), "LLM_PASS").when(~F.col("is_pass"), "LLM_FAIL").otherwise("PENDING")
    )
    return joined.withColumn("final_status", status)


def grade(score: str | Column) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 0.85, "完美 (Perfect)").when(score >= 0.6, "良好 (Good)").otherwise("需人工复核 (Check)")


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("score").alias("mean_score"), F.avg((F.col("score") >= 0.85).cast("double")).alias("top_share"))


def lowest(scored: DataFrame, key: str, limit: int = 3) -> DataFrame:
    return scored.orderBy("score", key).limit(limit)

"""Contradictory rules: permissions against prohibitions, and diverging thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.numbers import numeric_signatures
from rulegrain.functions.text import clean_text, has_any, json_or_single, scope_text
from rulegrain.operators.scale import number_rows, spread_join

POLARITY_CONFLICT = ("禁止/允许并存", "高")
THRESHOLD_CONFLICT = ("阈值口径不一致", "中")
POLARITY_REASON = "同一主体、同一事项下同时出现禁止性规则与允许性规则，需人工核对适用条件、例外条款和时点差异。"
THRESHOLD_REASON = "同一主体、同一事项下出现多个数值口径：{}，需检查是否属于不同条件、不同期限或版本差异。"

ALIASES = {"who": "who_text", "what": "what_text", "how": "how_text"}
STANDARD_COLUMNS = ["atom_id", "source_document", "article_reference", "rule_type", "who", "what", "how", "content_original"]


def standard_atoms(atoms: DataFrame) -> DataFrame:
    """Standard column names; an absent column reads as empty text (G1)."""
    names = set(atoms.columns)

    def pick(name: str) -> Column:
        source = name if name in names else ALIASES.get(name)
        return (clean_text(source) if source in names else F.lit("")).alias(name)

    if "label_paths" in names:
        kind = dict(atoms.dtypes)["label_paths"]
        labels = F.col("label_paths") if kind.startswith("array") else json_or_single("label_paths")
    else:
        labels = F.array().cast("array<string>")
    order = F.col("row_no") if "row_no" in names else F.lit(0)
    return atoms.select(*[pick(name) for name in STANDARD_COLUMNS], labels.alias("label_paths"), order.cast("long").alias("row_no"))


def with_scope_key(atoms: DataFrame, generic: list[str] = V.GENERIC_OBJECTS) -> DataFrame:
    """Normalised "who|what"; rows whose pair is too vague to compare are dropped."""
    keyed = atoms.withColumn("_who", scope_text("who")).withColumn("_what", scope_text("what"))
    clear = (F.col("_who") != "") & (F.length("_what") >= 4) & ~F.col("_what").isin(generic)
    return keyed.filter(clear).withColumn("scope_key", F.concat_ws("|", "_who", "_what")).drop("_who", "_what")


def with_polarity(
    atoms: DataFrame, forbid: list[str] = V.FORBID_KEYWORDS, allow: list[str] = V.ALLOW_KEYWORDS,
) -> DataFrame:
    """Wording decides before the rule type does."""
    by_type = F.lit("neutral")
    for name, value in V.RULE_TYPE_POLARITY.items():
        by_type = F.when(F.col("rule_type") == name, value).otherwise(by_type)
    signal = F.col("_signal")
    decided = F.when(has_any(signal, forbid), "forbid").when(has_any(signal, allow), "allow").otherwise(by_type)
    return (
        atoms.withColumn("_signal", F.concat_ws(" ", "how", "content_original"))
        .withColumn("polarity", decided).drop("_signal")
    )


def comparable_atoms(
    atoms: DataFrame, forbid: list[str] = V.FORBID_KEYWORDS, allow: list[str] = V.ALLOW_KEYWORDS, compat: bool = True,
) -> DataFrame:
    """Atoms that take part in conflict detection, with scope, polarity and signatures."""
    ready = standard_atoms(atoms).filter(F.col("rule_type").isin(V.ACTIONABLE_RULE_TYPES))
    scoped = with_polarity(with_scope_key(ready), forbid, allow)
    return scoped.withColumn("signatures", numeric_signatures(F.concat_ws(" ", "what", "how"), compat=compat))


def scope_groups(comparable: DataFrame, keys: tuple[str, ...] = ("scope_key",)) -> DataFrame:
    """One row per scope with at least two rules: counts, first subject, signature list.

    The only shuffle is one of scopes: rules merge map-side, so a scope with very many rules travels as its few distinct values, and a
    rule whose scope is rare travels once.
    """
    at = F.struct("row_no", "atom_id")
    merged = comparable.select(*keys, "who", "what", "polarity", "source_document", "label_paths", "signatures", at.alias("at")).groupBy(*keys).agg(
        F.count("*").alias("rule_count"), F.count_if(F.col("polarity") == "forbid").alias("forbid_count"), F.count_if(F.col("polarity") == "allow").alias("allow_count"),
        F.collect_set("source_document").alias("_documents"), F.collect_set("label_paths").alias("_labels"), F.collect_set("signatures").alias("_signatures"),
        F.min_by(F.struct("at", F.struct("who", "what").alias("pair")), "at").alias("_first"),
    ).filter(F.col("rule_count") >= 2)
    labels = F.filter(F.array_distinct(F.flatten("_labels")), lambda label: label != "")
    listed = merged.withColumn("_signatures", F.array_sort(F.array_distinct(F.flatten("_signatures"))))
    return listed.select(
        *keys, "rule_count", "forbid_count", "allow_count",
        F.size("_documents").cast("long").alias("document_count"), F.size(labels).cast("long").alias("label_count"),
        F.size("_signatures").cast("long").alias("signature_count"), F.slice("_signatures", 1, 5).alias("first_signatures"),
        F.col("_first.at").alias("first_row"), F.col("_first.pair").alias("first_pair"))


def scope_conflicts(groups: DataFrame) -> DataFrame:
    """Up to two conflicts per scope group, without ids."""

    def row(kind: int, names: tuple[str, str], reason: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(names[0]).alias("conflict_type"),
            F.lit(names[1]).alias("risk_level"), reason.alias("reason"),
        )

    before, after = THRESHOLD_REASON.split("{}")
    reason = F.concat(F.lit(before), F.array_join("first_signatures", " / "), F.lit(after))
    both = (F.col("forbid_count") > 0) & (F.col("allow_count") > 0)
    found = F.array_compact(F.array(
        F.when(both, row(1, POLARITY_CONFLICT, F.lit(POLARITY_REASON))),
        F.when(F.col("signature_count") >= 2, row(2, THRESHOLD_CONFLICT, reason)),
    ))
    return groups.withColumn("found", F.explode(found)).select("*", "found.*").drop("found")


def number_conflicts(comparable: DataFrame) -> DataFrame:
    """Conflicts with ids in order of first appearance of their scope."""
    found = scope_conflicts(scope_groups(comparable))
    return number_rows(found, ["first_row", "kind"], "conflict_no").withColumn(
        "conflict_id", F.format_string("CF-%04d", F.col("conflict_no"))
    )


def conflict_groups(numbered: DataFrame) -> DataFrame:
    """Report rows. Risk sorts as text (中 before 高); ``risk_rank`` offers the other way round."""
    return numbered.select(
        "conflict_id", "conflict_type", "risk_level", F.col("first_pair.who").alias("subject"),
        F.col("first_pair.what").alias("item"), "rule_count", "document_count", "label_count", "reason",
        F.when(F.col("risk_level") == "高", 1).otherwise(2).alias("risk_rank"),
    ).orderBy("risk_level", F.desc("rule_count"), F.desc("document_count"), "conflict_id")


def _sizes(numbered: DataFrame) -> DataFrame:
    """Rules of each conflicting scope; a scope can stand here twice, with the same count."""
    return numbered.groupBy("scope_key").agg(F.max("rule_count").alias("count"))


def conflict_details(comparable: DataFrame, numbered: DataFrame, most_paths: int | None = 3) -> DataFrame:
    """Every rule of every conflicting scope; its first ``most_paths`` label paths are shown, all with None."""
    paths = F.col("label_paths") if most_paths is None else F.slice("label_paths", 1, most_paths)
    members = spread_join(
        comparable, numbered.select("scope_key", "conflict_id", "conflict_type", "risk_level"), ["scope_key"], ["atom_id"], sizes=_sizes(numbered),
    )
    return members.select(
        "conflict_id", "conflict_type", "risk_level", "atom_id", "rule_type", "source_document", "article_reference",
        "who", "what", "how", F.array_join(paths, " | ").alias("business_label_paths"),
    ).orderBy("conflict_id", "risk_level", "rule_type", "atom_id")


def conflict_summary(comparable: DataFrame, numbered: DataFrame) -> DataFrame:
    affected = spread_join(
        comparable.select("scope_key", "atom_id"), numbered.select("scope_key").distinct(), ["scope_key"], ["atom_id"], sizes=_sizes(numbered)
    ).agg(F.countDistinct("atom_id").alias("affected_atom_count"))
    counts = numbered.agg(
        F.count("*").alias("group_count"),
        F.count_if(F.col("risk_level") == "高").alias("high_count"),
        F.count_if(F.col("risk_level") == "中").alias("medium_count"),
    )
    return counts.join(F.broadcast(affected))  # one row each


def detect_conflicts(atoms: DataFrame, compat: bool = True, **words: list[str]) -> dict[str, DataFrame]:
    """Conflict groups, their member rules and a summary."""
    comparable = comparable_atoms(atoms, compat=compat, **words)
    numbered = number_conflicts(comparable)
    return {
        "groups": conflict_groups(numbered),
        "details": conflict_details(comparable, numbered),
        "summary": conflict_summary(comparable, numbered),
    }

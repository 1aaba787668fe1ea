"""Import records and their queries: batches, artifacts, payload rows, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import is_true, strip, to_string_list, words

PAYLOAD_TABLES = {
    "phase1_entities": ["phase1_chunks"], "legal_atoms": ["legal_atoms"], "classified_atoms": ["legal_atoms", "scene_matches"],
    "taxonomy_catalog": ["taxonomy_modules", "taxonomy_scenes"], "taxonomy_recall_report": ["taxonomy_recall_queries"],
    "compliance_recall_report": ["compliance_recall_reports", "compliance_recall_rounds"],
    "sample_review_checklist": ["sample_review_rows"],
}


# ------------------------------------------------------------------ import
def content_hash(content: str | Column) -> Column:
    return F.sha1(F.col(content) if isinstance(content, str) else content)


def new_artifacts(candidates: DataFrame, registered: DataFrame, path: str = "artifact_path", content: str = "content") -> DataFrame:
    """Candidates with their hash and a status: imported, or skipped when path and hash are known (K7).

    Only hashes move: the content is hashed where it is read.
    """
    hashed = candidates.withColumn("sha1", content_hash(content)).drop(content)
    known = registered.select(F.col(path), "sha1", F.lit(True).alias("_known")).distinct()
    joined = hashed.join(known, [path, "sha1"], "left")
    return joined.withColumn("status", F.when(F.col("_known"), "skipped").otherwise("imported")).drop("_known")


def unique_items(items: DataFrame) -> DataFrame:
    """First entry of each (type, path) in listing order (K9).

    Entries are placed by path as they are and sorted there; sorting them before, to merge some early, would write whole contents twice.
    """
    placed = items.repartition("artifact_path")
    listing = Window.partitionBy("artifact_path", "artifact_type").orderBy(F.col("item_no").asc_nulls_last())
    first = placed.withColumn("_at", F.row_number().over(listing)).filter(F.col("_at") == 1)
    return first.select("artifact_type", "artifact_path", *[name for name in items.columns if name not in ("artifact_type", "artifact_path")])


def import_report(results: DataFrame) -> dict[str, DataFrame]:
    """Counts by status, and rows written per table (K26). ``table_counts`` is a map column."""
    by_status = results.groupBy("status").agg(F.count("*").alias("artifacts"))
    written = results.select(F.explode("table_counts").alias("table_name", "rows"))
    artifacts = results.filter(F.col("status") == "imported").select(F.lit("trace_artifacts").alias("table_name"), F.lit(1).cast("long").alias("rows"))
    batches = results.select(F.lit("trace_batches").alias("table_name"), F.lit(1).cast("long").alias("rows")).distinct()
    tables = written.union(artifacts).union(batches).groupBy("table_name").agg(F.sum("rows").alias("rows"))
    always = F.col("table_name").isin("trace_batches", "trace_artifacts")
    return {"by_status": by_status, "tables": tables.filter((F.col("rows") > 0) | always).orderBy(F.desc("rows"), "table_name")}


def trimmed_or_null(name: str) -> Column:
    return F.nullif(strip(name), F.lit(""))


def atom_payload(atoms: DataFrame, artifact_id: Column) -> DataFrame:
    """Atom rows typed for the lineage table (K8)."""
    listed = lambda name: (F.col(name) if dict(atoms.dtypes)[name].startswith("array") else to_string_list(name)) if name in atoms.columns else words([])
    return atoms.select(
        artifact_id.alias("artifact_id"),
        *[(trimmed_or_null(name) if name in atoms.columns else F.lit(None).cast("string")).alias(name) for name in (
            "atom_id", "source_document", "article_reference", "rule_type", "relation_type", "parent_atom_id", "review_reason")],
        *[(F.col(name) if name in atoms.columns else F.lit(None).cast("string")).alias(f"{name}_text") for name in ("who", "when", "where", "what", "how")],
        "content_original", (is_true("is_ambiguous") if "is_ambiguous" in atoms.columns else F.lit(False)).alias("is_ambiguous"),
        *[listed(name).alias(name) for name in ("label_codes", "label_paths", "sections", "categories", "modules", "related_scenarios")],
    )


def chunk_payload(chunks: DataFrame, artifact_id: Column) -> DataFrame:
    return chunks.select(
        artifact_id.alias("artifact_id"), trimmed_or_null("source_document").alias("source_document"), "chunk_index",
        F.size("entities").alias("entity_count"), "content_original", "entities",
    )


# ------------------------------------------------------------------ queries
def batch_list(batches: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Batches with artifact count and row total (K10); artifacts merge before they meet the batches."""
    totals = artifacts.groupBy("batch_id").agg(F.count("artifact_id").alias("artifact_count"), F.sum("row_count").alias("total_rows"))
    return batches.join(totals, "batch_id", "left").fillna(0, ["artifact_count", "total_rows"])


def artifact_list(batches: DataFrame, artifacts: DataFrame, limit: int, **equal: str) -> DataFrame:
    """Newest artifacts with their batch label, optionally of one batch or type."""
    rows = artifacts
    for name, value in equal.items():
        rows = rows.filter(F.col(name) == value)
    newest = rows.orderBy(F.desc("created_at"), "artifact_id").limit(limit)
    return newest.join(batches.select("batch_id", "batch_label"), "batch_id", "left").orderBy(F.desc("created_at"), "artifact_id")


def traced(rows: DataFrame, artifacts: DataFrame, batches: DataFrame) -> DataFrame:
    """Payload rows with their artifact and batch (K12, K13): inner joins on the lineage keys."""
    origin = artifacts.select("artifact_id", "batch_id", "artifact_type", "artifact_name", "created_at").join(
        batches.select("batch_id", "batch_label"), "batch_id"
    )
    return rows.join(origin, "artifact_id")


def atom_trace(atoms: DataFrame, artifacts: DataFrame, batches: DataFrame, atom_ids: DataFrame) -> DataFrame:
    """Every appearance of the wanted atoms, newest first."""
    wanted = atoms.join(atom_ids.select("atom_id").distinct(), "atom_id", "left_semi")
    return traced(wanted, artifacts, batches).orderBy("atom_id", F.desc("created_at"), "artifact_id")


def scene_trace(matches: DataFrame, artifacts: DataFrame, batches: DataFrame, atom_ids: DataFrame) -> DataFrame:
    """Every scene that the wanted atoms matched, in any batch; best score first, then newest."""
    wanted = matches.join(atom_ids.select("atom_id").distinct(), "atom_id", "left_semi")
    return traced(wanted, artifacts, batches).orderBy("atom_id", F.desc("score"), F.desc("created_at"), "artifact_id", "scene_key")


def report_list(reports: DataFrame, artifacts: DataFrame, batches: DataFrame, limit: int | None = 30) -> DataFrame:
    """Newest reports with artifact and batch."""
    rows = traced(reports, artifacts, batches).orderBy(F.desc("report_id"))
    return rows if limit is None else rows.limit(limit)


def classified_of(atoms: DataFrame, artifacts: DataFrame, batch_ids: DataFrame | None = None) -> DataFrame:
    """Atoms of classified artifacts, of the wanted batches or all, with batch and time."""
    origin = artifacts.filter(F.col("artifact_type") == "classified_atoms").select("artifact_id", "batch_id", "created_at")
    if batch_ids is not None:
        origin = origin.join(batch_ids.select("batch_id").distinct(), "batch_id", "left_semi")
    return atoms.join(origin, "artifact_id")


def report_rounds(reports: DataFrame, rounds: DataFrame, report_ids: DataFrame) -> DataFrame:
    """Rounds of the artifacts of the wanted reports."""
    wanted = reports.join(report_ids, "report_id", "left_semi").select("artifact_id").distinct()
    return rounds.join(wanted, "artifact_id", "left_semi").orderBy("artifact_id", "round_index")


def scene_summary(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Atoms per scene."""
    counted = matches.groupBy("module_code", "scene_key").agg(F.count("*").alias("atom_count")).orderBy(F.desc("atom_count"), "scene_key")
    return counted if limit is None else counted.limit(limit)


def business_summary(classified: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of batch measures over classified atoms."""
    codes = F.filter("label_codes", lambda code: (code != "") & (code != V.UNCLASSIFIED_CODE))
    sized = classified.select("source_document", codes.alias("codes")).withColumn("n", F.size("codes"))
    base = sized.agg(
        F.count("*").alias("classified_atom_count"), F.count_if(F.col("n") > 0).alias("labelled_atom_count"),
        F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("avg_labels_per_atom"), F.count_if(F.col("n") > 1).alias("multi_label_atom_count"),
        F.countDistinct("source_document").alias("document_count"),
    )
    modules = sized.select(F.explode("codes").alias("code")).agg(F.countDistinct("code").alias("module_count"))
    scenes = matches.agg(F.countDistinct("scene_key").alias("scene_count"))
    return base.join(F.broadcast(modules)).join(F.broadcast(scenes))  # one row each


def module_counts(classified: DataFrame) -> DataFrame:
    """Atoms per module code and name: the name is the last part of the label path."""
    pairs = F.arrays_zip(F.col("label_codes").alias("code"), F.col("label_paths").alias("path"))
    rows = classified.select(F.explode(pairs).alias("p")).select("p.*").toDF("code", "path").filter(
        F.col("code").isNotNull() & (F.col("code") != V.UNCLASSIFIED_CODE)
    )
    name = F.when(F.contains("path", F.lit(">")), strip(F.substring_index("path", ">", -1))).otherwise(F.coalesce("path", "code"))
    return rows.groupBy("code", name.alias("module_name")).agg(F.count("*").alias("atom_count"))


def table_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every lineage table."""
    out = None
    for name, rows in sorted(tables.items()):
        counted = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = counted if out is None else out.union(counted)
    return out


def table_preview(rows: DataFrame, order: list[str], limit: int = 200, most: int = 500) -> DataFrame:
    """First rows by the first present key, newest first, ties by the other columns; at most ``most``."""
    key = next(name for name in order if name in rows.columns)
    return rows.orderBy(F.desc(key), *[name for name, kind in rows.dtypes if name != key and not kind.startswith("map")]).limit(min(limit, most))


# ------------------------------------------------------------------ term mapping (K6)
MAPPING = "struct<mappings:array<struct<legal_term:string,domain_mapping:string,domain_entity:string,mapping_logic:string,confidence:string>>>"


def mapping_table(results: DataFrame) -> DataFrame:
    """External mapping answers (atom_id, content_original, answer JSON) to one row per mapping (K6)."""
    long_enough = results.filter(F.length("content_original") >= 5)
    parsed = long_enough.withColumn("m", F.from_json("answer", MAPPING)["mappings"])
    return parsed.select("atom_id", "content_original", F.explode("m").alias("m")).select(
        F.coalesce("atom_id", F.lit("UNK")).alias("source_atom_id"), F.coalesce("m.legal_term", F.lit("未知")).alias("legal_term"),
        F.coalesce("m.domain_mapping", "m.domain_entity", F.lit("未映射")).alias("domain_mapping"),
        F.coalesce("m.mapping_logic", F.lit("")).alias("mapping_logic"), F.coalesce("m.confidence", F.lit("Low")).alias("confidence"),
        F.concat(F.substring("content_original", 1, 50), F.lit("...")).alias("source_content"),
    )

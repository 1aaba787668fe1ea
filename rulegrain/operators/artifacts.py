"""Bundles of artifacts: JSON payloads of seven kinds read into typed tables; an item that cannot be read is set aside with a reason.

A bundle is a table of items (item_no, artifact_type, artifact_path, content). All items of a kind are read by one job: the payload is
parsed by the schema of its kind with text leaves, the leaves are tried as their types, and what fails marks its item alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulegrain.functions.text import is_true, strip
from rulegrain.operators.lineage import content_hash, unique_items
from rulegrain.session import cut_lineage


@dataclass(frozen=True)
class Table:
    """One table that a kind fills: where its rows stand in the payload, and (column, source field, type) of each."""

    name: str
    rows: str
    columns: tuple[tuple[str, str, str], ...]


def _same(kind: str, *names: str) -> tuple[tuple[str, str, str], ...]:
    return tuple((name, name, kind) for name in names)


# Fields of the payloads. Types: key (trimmed, empty as null), text, int, bool, list (JSON or literal list), json (kept as it is).
_ATOM = (
    *_same("key", "atom_id", "source_document", "article_reference", "rule_type", "relation_type", "parent_atom_id"),
    *((f"{name}_text", name, "text") for name in ("who", "when", "where", "what", "how")), ("content_original", "content_original", "text"),
    ("is_ambiguous", "is_ambiguous", "bool"), ("review_reason", "review_reason", "key"),
    ("label_codes", "business_taxonomy_label_codes", "list"), ("label_paths", "business_taxonomy_label_paths", "list"), ("sections", "business_sections_v2", "list"),
    ("categories", "business_categories_v2", "list"), ("modules", "business_modules_v2", "list"), ("related_scenarios", "related_scenarios", "list"),
    ("classification_reason", "business_classification_reason", "text"))
KINDS: dict[str, tuple[Table, ...]] = {
    "phase1_entities": (Table("phase1_chunks", "rows", (
        ("source_document", "source_document", "key"), ("chunk_index", "chunk_index", "int"), ("content_original", "content_original", "text"), ("entities", "ner_entities_json", "list"))),),
    "legal_atoms": (Table("legal_atoms", "rows", _ATOM),),
    "taxonomy_catalog": (
        Table("taxonomy_modules", "modules", (("code", "code", "key"), *_same("text", "section", "category", "module", "label_path", "projects_text", "remark"))),
        Table("taxonomy_scenes", "scenes", (("scene_key", "scene_key", "key"), *_same("text", "scene_name", "module_code", "module", "category", "section", "label_path"), ("scene_terms", "scene_terms", "list")))),
    "classified_atoms": (
        Table("legal_atoms", "atoms", _ATOM),
        Table("scene_matches", "scene_matches", (*_same("key", "atom_id", "scene_key"), *_same("text", "scene_name", "module_code"), ("score", "score", "int"), ("matched_terms", "matched_terms", "list")))),
    "taxonomy_recall_report": (Table("taxonomy_recall_queries", "results", (
        ("query_text", "query", "key"), ("raw_query", "raw_query", "text"),
        *_same("int", "matched_scene_count", "retrieved_atom_count", "broad_recall_count", "precise_recall_count", "who_refined_count"))),),
    "compliance_recall_report": (
        Table("compliance_recall_reports", "", (
            *_same("text", "question", "raw_query", "final_decision", "judge_final_decision", "stop_reason"), ("can_make_final", "can_make_final_compliance_judgement", "bool"),
            ("final_count", "final_recall_atom_count", "int"))),
        Table("compliance_recall_rounds", "rounds", (("round_index", "round", "int"), *_same("int", "input_atom_count", "output_atom_count", "new_atom_count")))),
    "sample_review_checklist": (Table("sample_review_rows", "sheets", (
        ("sheet_name", "sheet_name", "text"), ("sample_group", "样本组", "key"), ("sample_label", "样本标签", "key"), ("sample_id", "样本ID", "key"), ("judgement", "判定", "key"), ("notes", "备注", "text"))),),
}
BARE = {"phase1_entities", "legal_atoms"}  # payloads that are a bare array of rows
UNREVIEWED = ["summary", "notes"]  # sheets of a checklist that hold no samples
# File name patterns of a folder by kind, in import order; of checklists only the last by name counts.
FILES = [("phase1_entities", "phase1_entities_checkpoint%"), ("legal_atoms", "legal_atoms_v4_final%"), ("taxonomy_catalog", "business_taxonomy_catalog%"),
         ("classified_atoms", "legal_atoms_business_taxonomy%"), ("taxonomy_recall_report", "business_taxonomy_recall_report%"), ("compliance_recall_report", "compliance_recall%"),
         ("sample_review_checklist", "sample_review_checklist\\_%")]
_SQL = {"key": "string", "text": "string", "int": "int", "bool": "boolean", "list": "array<string>", "json": "string"}


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the JSON files of a folder, told by their names; files of other names are left out."""
    files = spark.read.option("wholetext", True).text(folder, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("artifact_path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    kind = reduce(lambda rest, pair: F.when(F.col("name").like(pair[1]), F.lit(pair[0])).otherwise(rest), reversed(FILES), F.lit(None).cast("string"))
    found = files.withColumn("artifact_type", kind).filter("artifact_type IS NOT NULL")
    last = found.filter(F.col("artifact_type") == "sample_review_checklist").agg(F.max("name").alias("last"))
    found = found.join(F.broadcast(last)).filter((F.col("artifact_type") != "sample_review_checklist") | (F.col("name") == F.col("last")))  # one row
    place = reduce(lambda rest, at: F.when(F.col("artifact_type") == FILES[at][0], at).otherwise(rest), range(len(FILES)), F.lit(len(FILES)))
    return found.select(F.struct(place.alias("kind"), "name").alias("item_no"), "artifact_type", "artifact_path", "content")


def _schema(kind: str) -> str:
    """The payload's schema with text leaves, and a field for what can't be read."""
    fields = []
    for table in KINDS[kind]:
        leaves = ",".join(f"`{source}`:string" for _, source, _ in table.columns)
        if kind == "sample_review_checklist":
            fields.append("sheets:map<string,array<map<string,string>>>")
        elif table.rows:
            fields.append(f"{table.rows}:array<struct<{leaves}>>")
        else:
            fields.append(leaves)
    return f"struct<{','.join(fields)},_broken:string>"


def _value(row: Column, source: str, kind: str) -> Column:
    raw = row[source]
    if kind == "key":
        return F.nullif(strip(raw), F.lit(""))
    if kind == "int":
        return strip(raw).try_cast("int")
    if kind == "bool":
        return is_true(raw)
    if kind == "list":
        return F.from_json(raw, "array<string>")
    return raw


def _bad(row: Column, source: str, kind: str) -> Column:
    """Whether a leaf is given but is not of its type."""
    raw = strip(row[source])
    if kind == "int":
        return (raw != "") & raw.try_cast("int").isNull()
    if kind == "list":
        return (raw != "") & ~F.startswith(raw, F.lit("["))
    return F.lit(False)


def _rows_of(table: Table, kind: str) -> Column:
    if kind == "sample_review_checklist":
        sheets = F.filter(F.map_entries("p.sheets"), lambda sheet: ~sheet["key"].isin(UNREVIEWED))
        return F.flatten(F.transform(sheets, lambda sheet: F.transform(sheet["value"], lambda row: F.map_concat(F.map_filter(row, lambda name, _: name != "sheet_name"), F.create_map(F.lit("sheet_name"), sheet["key"])))))
    return F.col(f"p.{table.rows}") if table.rows else F.array("p")


def parsed(items: DataFrame, kind: str) -> DataFrame:
    """Items of one kind with ``p`` (the payload) and ``error`` (null where every leaf is of its type)."""
    content = F.concat(F.lit('{"rows":'), F.col("content"), F.lit("}")) if kind in BARE else F.col("content")
    rows = items.filter(F.col("artifact_type") == kind).withColumn("p", F.from_json(content, _schema(kind), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    error = F.when(F.col("p").isNull() | F.col("p._broken").isNotNull(), "unreadable payload")
    for table in KINDS[kind]:
        listed = _rows_of(table, kind)
        if table.rows:
            error = error.when(listed.isNull(), f"{table.rows} is missing")

        def wrong(source: str, leaf: str) -> Callable[[Column], Column]:
            return lambda row: F.coalesce(_bad(row, source, leaf), F.lit(False))

        for _, source, leaf in table.columns:
            if leaf in ("int", "list"):
                error = error.when(F.exists(listed, wrong(source, leaf)), f"{source} is no {'number' if leaf == 'int' else 'list'}")
    return rows.withColumn("error", error)


@dataclass(frozen=True)
class Import:
    """``results``: a row per item with status, error, row count and rows per table; ``tables``: typed rows by table name."""

    results: DataFrame
    tables: dict[str, DataFrame]


def sync(items: DataFrame, batch_id: str, registered: DataFrame | None = None) -> Import:
    """Import a bundle (K8, K9): every item ends as imported, skipped (path and content known), or failed with its reason.

    Of items with one type and path the first by ``item_no`` counts. ``registered`` has artifact_path and sha1 of what is stored already.
    An item is imported whole or not at all; a broken one stops nothing else.
    """
    unique = unique_items(items).withColumn("sha1", content_hash("content"))
    unique = unique.withColumn("artifact_id", F.sha1(F.concat_ws("\x1f", F.lit(batch_id), "artifact_type", "artifact_path", "sha1")))
    if registered is None:
        known = unique.withColumn("known", F.lit(False))
    else:
        # met by path alone, as which the items are placed already: contents move once
        seen = registered.groupBy("artifact_path").agg(F.collect_set("sha1").alias("seen"))
        known = unique.join(seen, "artifact_path", "left").withColumn("known", F.coalesce(F.array_contains("seen", F.col("sha1")), F.lit(False))).drop("seen")
    known = cut_lineage(known)
    head = ["item_no", "artifact_type", "artifact_path", "sha1", "artifact_id"]
    texts = lambda *pairs: F.create_map(*[part for pair in pairs for part in pair])
    none = F.create_map().cast("map<string,bigint>")
    parts, tables = [], {}
    fresh = known.filter("NOT known")
    for kind, fills in KINDS.items():
        read = cut_lineage(parsed(fresh, kind).drop("content"))  # read once per kind: a filter on the error would repeat the parsing for each leaf
        sizes = [(F.lit(table.name), F.size(_rows_of(table, kind)).cast("long")) for table in fills]
        total = reduce(lambda a, b: a + b, [size for _, size in (sizes if kind != "compliance_recall_report" else sizes[:1])])
        good = F.col("error").isNull()
        parts.append(read.select(*head, F.when(good, "imported").otherwise("failed").alias("status"), "error", F.when(good, total).otherwise(0).cast("long").alias("row_count"),
                                 F.when(good, texts(*sizes)).otherwise(none).alias("table_counts")))
        for table in fills:
            rows = read.filter(good).select("artifact_id", "artifact_path", F.posexplode(_rows_of(table, kind)).alias("position", "r"))
            typed = rows.select("artifact_id", "artifact_path", "position", *[_value(F.col("r"), source, leaf).cast(_SQL[leaf]).alias(name) for name, source, leaf in table.columns])
            tables[table.name] = typed if table.name not in tables else tables[table.name].unionByName(typed)
    rest = known.filter(F.col("known") | ~F.col("artifact_type").isin(list(KINDS)) | F.col("artifact_type").isNull())
    parts.append(rest.select(*head, F.when(F.col("known"), "skipped").otherwise("failed").alias("status"),
                             F.when(~F.col("known"), F.concat(F.lit("unsupported artifact type: "), F.coalesce("artifact_type", F.lit("")))).alias("error"), F.lit(0).cast("long").alias("row_count"), none.alias("table_counts")))
    return Import(reduce(DataFrame.unionByName, parts).withColumn("batch_id", F.lit(batch_id)), tables)


def registrations(results: DataFrame) -> DataFrame:
    """What a later import should know: path and hash of every imported item."""
    return results.filter(F.col("status") == "imported").select("artifact_path", "sha1")

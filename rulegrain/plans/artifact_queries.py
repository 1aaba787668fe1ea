"""Queries for bundle imports: payloads of all seven kinds are written as JSON from the given tables, some of them broken, and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.operators import artifacts as A
from rulegrain.operators.lineage import content_hash
from rulegrain.plans.corpus import derive, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _json(**fields) -> F.Column:
    return F.struct(*[(F.col(value) if isinstance(value, str) else value).alias(name) for name, value in fields.items()])


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


def _lines(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Order lines of one key as an array, in order: an order and a part have few lines. Only fields of the lines travel; rows are built from them."""
    fields = F.struct(*[name for name in LINE if name != key])
    return table(spark, sf_dir, "lineitem").groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(fields)).alias("lines"))


def _each(key: str, row) -> F.Column:
    """The lines as rows; ``row`` gets the fields of a line by name."""
    return F.transform("lines", lambda line: row(lambda name: F.col("key") if name == key else line[name]))


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per document, order, part, conversation and region. Every 17th payload is cut short, every 13th chunk number is no number."""
    documents = table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    chunk = _json(source_document="source", chunk_index=number, content_original="text", ner_entities_json=F.array("lang", F.lit("a 'b'")))
    parts = [documents.select(F.col("doc_id").alias("key"), F.lit("phase1_entities").alias("artifact_type"), F.to_json(F.array(chunk)).alias("content"))]
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority")
    by_order = _lines(spark, sf_dir, "l_orderkey").join(orders, "key")
    atom = lambda at: _json(atom_id=F.concat(F.lit(" A"), at("l_orderkey"), F.lit("-"), at("l_linenumber")), rule_type=at("l_returnflag"), who=F.lit("who"), how=F.lit(""), is_ambiguous=(at("l_linestatus") == "O").cast("string"),
                            business_taxonomy_label_codes=F.array(at("l_linestatus"), at("l_returnflag")))
    with_atoms = by_order.withColumn("rows", _each("l_orderkey", atom))
    parts.append(with_atoms.filter("o_orderstatus = 'F'").select("key", F.lit("legal_atoms"), F.to_json("rows")))
    match = F.transform("rows", lambda row: _json(atom_id=row["atom_id"], scene_key=F.col("o_orderpriority"), scene_name=F.lit("s"), module_code=F.lit("m"), score=F.lit(7), matched_terms=F.array("o_orderpriority")))
    parts.append(with_atoms.filter("o_orderstatus = 'O'").select("key", F.lit("classified_atoms"), F.to_json(F.struct(F.col("rows").alias("atoms"), match.alias("scene_matches")))))
    each = lambda at: _json(round=at("l_linenumber"), input_atom_count=at("l_quantity").cast("int"), output_atom_count=F.lit(3), new_atom_count=F.lit(None).cast("int"))
    parts.append(by_order.withColumn("rows", _each("l_orderkey", each)).filter("o_orderstatus = 'P'").select("key", F.lit("compliance_recall_report"), F.to_json(F.struct(
        F.col("o_orderpriority").alias("question"), F.lit("停止召回").alias("final_decision"), F.lit(True).alias("can_make_final_compliance_judgement"), F.size("rows").alias("final_recall_atom_count"), F.col("rows").alias("rounds")))))
    sample = lambda at: F.struct(at("l_returnflag").alias("样本组"), F.concat(at("l_orderkey"), F.lit("/"), at("l_linenumber")).alias("样本ID"), F.when(at("l_linestatus") == "O", "通过").otherwise(" ").alias("判定"))
    sheets = F.to_json(F.struct(F.struct(F.col("rows").alias("atoms"), F.slice("rows", 1, 1).alias("summary")).alias("sheets")))
    parts.append(_lines(spark, sf_dir, "l_partkey").withColumn("rows", _each("l_partkey", sample)).select("key", F.lit("sample_review_checklist"), sheets))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    results = F.transform("turns", lambda row: _json(query=row["role"], raw_query=row["role"], broad_recall_count=row["turn"]))
    parts.append(turns.select("key", F.lit("taxonomy_recall_report"), F.to_json(F.struct(results.alias("results")))))
    nations = derive(spark, sf_dir, "SELECT n_regionkey AS key, transform(sort_array(collect_list(struct(n_nationkey, n_name))), m -> named_struct('code', CAST(m.n_nationkey AS STRING), 'module', m.n_name)) AS modules FROM {nation} GROUP BY n_regionkey")
    parts.append(nations.select("key", F.when(F.col("key") == 4, "picture").otherwise("taxonomy_catalog"), F.to_json(F.struct("modules", F.array(F.struct(F.lit("k").alias("scene_key"), F.array(F.lit("t")).alias("scene_terms"))).alias("scenes")))))
    items = reduce(lambda a, b: a.union(b), parts).withColumn("content", F.when(F.col("key") % 17 == 0, F.expr("left(content, length(content) - 3)")).otherwise(F.col("content")))
    return items.select(F.struct("artifact_type", "key").alias("item_no"), "artifact_type", F.concat("artifact_type", F.lit("/"), F.col("key").cast("string")).alias("artifact_path"), "content")


def imported(spark: SparkSession, sf_dir: str) -> A.Import:
    """Every item listed twice, and those with a path that ends in 11 stored before."""
    items = bundle(spark, sf_dir)
    stored = items.filter(F.col("artifact_path").like("%11")).select("artifact_path", content_hash("content").alias("sha1"))
    later = items.withColumn("item_no", F.struct(F.lit("z").alias("artifact_type"), F.col("item_no.key").alias("key")))
    return A.sync(items.union(later), "batch", stored)


@query
def bundle_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = imported(spark, sf_dir).results
    return out.groupBy("artifact_type", "status", F.coalesce("error", F.lit("")).alias("error")).agg(
        F.count("*").alias("items"), F.sum("row_count").alias("rows"), F.sum(F.aggregate(F.map_values("table_counts"), F.lit(0).cast("long"), lambda a, n: a + n)).alias("table_rows"))


@query
def bundle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all nine tables with their typed fields as one text, counted."""
    parts = []
    for name, rows in imported(spark, sf_dir).tables.items():
        shown = [F.coalesce(F.array_join(field, "+") if kind.startswith("array") else F.length(field).cast("string") if field == "content_original" else F.col(field).cast("string"), F.lit("~"))
                 for field, kind in rows.dtypes if field not in ("artifact_id", "artifact_path", "position")]
        parts.append(rows.select(F.lit(name).alias("table_name"), "artifact_path", "position", F.concat_ws("|", *shown).alias("fields")))
    return reduce(DataFrame.union, parts)


_BODY = """WITH status AS (SELECT o_orderkey AS key, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS pos, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS part_pos FROM lineitem),
atoms AS (SELECT l_orderkey AS key, pos, 'A' || l_orderkey || '-' || l_linenumber || '|~|~|' || l_returnflag || '|~|~|who|~|~|~||~|' || CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END || '|~|' || l_linestatus || '+' || l_returnflag || '|~|~|~|~|~|~' AS f,
  'A' || l_orderkey || '-' || l_linenumber || '|' || pr || '|s|m|7|' || pr AS m, st FROM lines JOIN status ON key = l_orderkey),
listed AS (
  SELECT 'phase1_entities' AS kind, doc_id AS key, 'phase1_chunks' AS table_name, 0 AS position, source || '|' || doc_id || '|' || length(text) || '|' || lang || '+a ''b''' AS fields FROM documents
  UNION ALL SELECT 'legal_atoms', key, 'legal_atoms', pos, f FROM atoms WHERE st = 'F'
  UNION ALL SELECT 'classified_atoms', key, 'legal_atoms', pos, f FROM atoms WHERE st = 'O'
  UNION ALL SELECT 'classified_atoms', key, 'scene_matches', pos, m FROM atoms WHERE st = 'O'
  UNION ALL SELECT 'compliance_recall_report', l_orderkey, 'compliance_recall_rounds', pos, l_linenumber || '|' || CAST(l_quantity AS INTEGER) || '|3|~' FROM lines JOIN status ON key = l_orderkey WHERE st = 'P'
  UNION ALL SELECT 'compliance_recall_report', l_orderkey, 'compliance_recall_reports', 0, any_value(pr) || '|~|停止召回|~|~|true|' || count(*) FROM lines JOIN status ON key = l_orderkey WHERE st = 'P' GROUP BY l_orderkey
  UNION ALL SELECT 'sample_review_checklist', l_partkey, 'sample_review_rows', part_pos, 'atoms|' || l_returnflag || '|~|' || l_orderkey || '/' || l_linenumber || '|' || CASE WHEN l_linestatus = 'O' THEN '通过' ELSE '~' END || '|~' FROM lines
  UNION ALL SELECT 'taxonomy_recall_report', conv_id, 'taxonomy_recall_queries', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, role || '|' || role || '|~|~|' || turn || '|~|~' FROM conversations
  UNION ALL SELECT CASE WHEN n_regionkey = 4 THEN 'picture' ELSE 'taxonomy_catalog' END, n_regionkey, 'taxonomy_modules', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1, n_nationkey || '|~|~|' || n_name || '|~|~|~' FROM nation
  UNION ALL SELECT CASE WHEN r_regionkey = 4 THEN 'picture' ELSE 'taxonomy_catalog' END, r_regionkey, 'taxonomy_scenes', 0, 'k|~|~|~|~|~|~|t' FROM region),
judged AS (SELECT *, kind || '/' || key AS path, CASE WHEN kind || '/' || key LIKE '%11' THEN 'skipped' WHEN kind = 'picture' OR key % 17 = 0 OR (kind = 'phase1_entities' AND key % 13 = 0) THEN 'failed' ELSE 'imported' END AS status,
  CASE WHEN kind = 'picture' THEN 'unsupported artifact type: picture' WHEN key % 17 = 0 THEN 'unreadable payload' WHEN kind = 'phase1_entities' AND key % 13 = 0 THEN 'chunk_index is no number' END AS why FROM listed)
"""
ORACLE["bundle_rows"] = _BODY + "SELECT table_name, path AS artifact_path, CAST(position AS INTEGER) AS position, fields FROM judged WHERE status = 'imported'"
ORACLE["bundle_results"] = _BODY + """SELECT kind AS artifact_type, status, CASE WHEN status = 'failed' THEN why ELSE '' END AS error, count(DISTINCT path) AS items,
  count(*) FILTER (status = 'imported' AND table_name <> 'compliance_recall_rounds') AS rows, count(*) FILTER (status = 'imported') AS table_rows FROM judged GROUP BY 1, 2, 3"""

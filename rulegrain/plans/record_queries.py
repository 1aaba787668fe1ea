"""Queries for records that pass through files and fixed forms: written and read back, flattened, numbered, split, checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.functions import vocab as V
from rulegrain.operators import instruments as I, lineage as L, quality as Q, segment as S, taxonomy as X
from rulegrain.plans import artifact_queries
from rulegrain.plans.corpus import ORDER_RULES, ansi, derive, table
from rulegrain.plans.graph_queries import CLASSIFIED, MODULES, classified_orders, modules_of, order_rules
from rulegrain.plans.table_queries import ARTIFACTS, BATCHES, CHECKED, PAYLOADS
from rulegrain.session import shared_folder
from rulegrain.sources import readers, writers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ files
@query
def atoms_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms with null references, written by rule type and read with nulls as empty text."""
    path = shared_folder(spark, "atoms")
    atoms = order_rules(spark, sf_dir).select("atom_id", "rule_type", "who", F.nullif("article_reference", F.lit("")).alias("article_reference"))
    writers.write_atoms(atoms, path, "rule_type")
    return readers.read_atoms(spark, path).select("atom_id", "rule_type", "who", "article_reference")


ORACLE["atoms_read_back"] = f"SELECT atom_id, rule_type, who, article_reference FROM ({ansi(ORDER_RULES)})"


@query
def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule text through CSV files whose encoding the reader finds out."""
    path = shared_folder(spark, "csv")
    order_rules(spark, sf_dir).select("atom_id", "who", "what", "how").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, ["what", "who", "how"]).groupBy("what", "how").agg(F.count("*").alias("atoms"), F.min("who").alias("first_who"))


ORACLE["csv_read_back"] = f"SELECT what, how, count(*) AS atoms, min(who) AS first_who FROM ({ansi(ORDER_RULES)}) GROUP BY 1, 2"


@query
def catalog_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, scenes and metadata written as a catalog; scenes stored without terms get those of their names."""
    path = shared_folder(spark, "catalog")
    modules = modules_of(spark, sf_dir)
    scenes = X.taxonomy_scenes(modules).withColumn("scene_terms", F.when(F.col("scene_key").like("%1"), F.lit("")).otherwise(F.to_json("scene_terms")))
    writers.write_tables({"modules": modules, "scenes": scenes, "metadata": spark.createDataFrame([("version", "1")], "key string, value string")}, path)
    return readers.read_catalog(spark, path)["scenes"].select("scene_key", "module_code", F.array_join("scene_terms", "|").alias("terms"))


ORACLE["catalog_read_back"] = MODULES + "SELECT scene_key, module_code, scene_name AS terms FROM scenes"


@query
def check_runs_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check run and its results as stored tables; payload rows pass the scalar clean-up first."""
    path = shared_folder(spark, "runs")
    checks = I.payload_checks(readers.scalar_rows(derive(spark, sf_dir, PAYLOADS)))
    writers.write_tables(I.run_rows(checks, I.payload_summary(checks), "run"), path)
    runs, results = (readers.read_table(spark, f"{path}/{name}") for name in ("compliance_runs", "run_results"))
    return results.select("run_id", "sequence", "status").join(runs.select("run_id", "overall_status"), "run_id")


ORACLE["check_runs_read_back"] = CHECKED + """SELECT 'run:' || payload_id AS run_id, sequence, status,
  CASE WHEN bool_or(status = 'FAIL') OVER (PARTITION BY payload_id) THEN 'FAIL' WHEN bool_or(status = 'PASS') OVER (PARTITION BY payload_id) THEN 'PASS' ELSE 'SKIP' END AS overall_status FROM checks"""


@query
def reports_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON lines."""
    path = shared_folder(spark, "reports")
    writers.write_reports(classified_orders(spark, sf_dir).select("atom_id", "label_codes"), path)
    rows = readers.read_table(spark, path, "json", "atom_id string, label_codes array<string>")
    return rows.select(F.explode("label_codes").alias("code")).groupBy("code").agg(F.count("*").alias("atoms"))


ORACLE["reports_read_back"] = CLASSIFIED + """SELECT code, count(*) AS atoms FROM (SELECT unnest(coalesce(codes, ['UNCAT-00-00'])) AS code FROM atoms LEFT JOIN labels USING (atom_id)) GROUP BY 1"""


# ------------------------------------------------------------------ atoms and lines
@query
def flattened_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested extracted rules to flat rows with semantic ids; lists joined, absent parts named so."""
    rows = order_rules(spark, sf_dir)
    parts = F.struct(F.split("who", "、").alias("who"), F.when(F.col("when") != "当日", F.col("when")).alias("when"), F.col("where"), F.array(F.lit(""), F.col("what")).alias("what"), F.col("how"))
    nested = rows.select("row_no", F.when(F.col("rule_type") != "PRC_FLOW", F.col("rule_type")).alias("rule_type"),
                         F.concat(F.when(F.col("row_no") % 2 == 0, "支付结算").otherwise(""), "source_document").alias("source_document"), parts.alias("behavior_struct"))
    return S.flatten_atoms(nested, ["row_no"]).select("atom_id", "row_no", "who", "when", "what")


_CODE = "CASE " + " ".join(f"WHEN contains(doc, '{word}') THEN '{code}'" for word, code in V.DOCUMENT_CODES) + " ELSE 'GEN' END"
ORACLE["flattened_atoms"] = f"""WITH a AS (SELECT *, CASE WHEN row_no % 2 = 0 THEN '支付结算' ELSE '' END || source_document AS doc FROM ({ansi(ORDER_RULES)}))
SELECT 'YZ-' || {_CODE} || '-' || CASE WHEN rule_type = 'PRC_FLOW' THEN 'UNKNOWN' ELSE split_part(rule_type, '_', 1) END || '-' || lpad(CAST(row_number() OVER (ORDER BY row_no) AS STRING), CAST(greatest(5, length(CAST(row_number() OVER (ORDER BY row_no) AS STRING))) AS INTEGER), '0') AS atom_id,
  row_no, who, CASE WHEN "when" = '当日' THEN '{V.UNSPECIFIED}' ELSE "when" END AS "when", what FROM a"""

LINES = """SELECT c_custkey AS line_no, CASE c_custkey % 6 WHEN 0 THEN '# ' || c_name WHEN 1 THEN ' ' WHEN 2 THEN c_name || ' 可以吗' WHEN 3 THEN c_name || ' | 查询::' || c_mktsegment
  WHEN 4 THEN c_name || '｜ ｜' || c_mktsegment ELSE ' ' || c_name || chr(9) || c_mktsegment || chr(9) || '甲' END AS value FROM {customer}"""


@query
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.batch_questions(derive(spark, sf_dir, LINES), default_who="默认主体")


ORACLE["question_lines"] = f"""SELECT CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS index, line_no, question, query, who FROM (
  SELECT c_custkey AS line_no, c_name || CASE WHEN c_custkey % 6 = 2 THEN ' 可以吗' ELSE '' END AS question,
    CASE c_custkey % 6 WHEN 2 THEN c_name || ' 可以吗' WHEN 3 THEN '查询::' || c_mktsegment WHEN 4 THEN c_name ELSE c_mktsegment END AS query,
    CASE c_custkey % 6 WHEN 2 THEN '默认主体' WHEN 3 THEN '' WHEN 4 THEN c_mktsegment ELSE '甲' END AS who FROM customer WHERE c_custkey % 6 > 1)"""

CITED = """SELECT o_orderkey AS source_id, o_orderstatus = 'P' AS appendix, CASE WHEN o_orderstatus = 'P' THEN '附一：一、' || o_orderpriority || '十一、' || CAST(o_custkey AS STRING)
  ELSE '引言 第' || CAST(o_orderkey AS STRING) || '条 ' || o_orderpriority || '第二条' || CAST(o_custkey AS STRING) END AS body FROM {orders}"""


@query
def citation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_citations(derive(spark, sf_dir, CITED), "body", "appendix").select("source_id", "chunk_no", "chunk")


ORACLE["citation_chunks"] = """SELECT o_orderkey AS source_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS chunk_no, unnest(parts) AS chunk FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ['一、' || o_orderpriority, '十一、' || o_custkey]
    ELSE ['引言', '第' || o_orderkey || '条 ' || o_orderpriority, '第二条' || o_custkey] END AS parts FROM orders)"""


@query
def labeller_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.labeller_batches(order_rules(spark, sf_dir)).select("atom_id", "batch_no", "what", F.array_join("legacy_business_categories", "|").alias("categories"))


ORACLE["labeller_rows"] = f"""SELECT atom_id, CAST((row_number() OVER (ORDER BY row_no) - 1) // 12 + 1 AS BIGINT) AS batch_no, what, substr(business_categories, 3, length(business_categories) - 4) AS categories FROM ({ansi(ORDER_RULES)})"""


@query
def dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.taxonomy_dimensions(modules_of(spark, sf_dir))
    return (found["boards"].select(F.lit("board").alias("kind"), F.col("name").alias("key"), "name")
            .unionByName(found["categories"].select(F.lit("category").alias("kind"), "key", "name")).unionByName(found["modules"].select(F.lit("module").alias("kind"), F.col("code").alias("key"), "name")))


ORACLE["dimension_rows"] = MODULES + """SELECT DISTINCT 'board' AS kind, section AS key, section AS name FROM modules UNION ALL SELECT DISTINCT 'category', section || '::' || category, category FROM modules
UNION ALL SELECT 'module', code, module FROM modules
UNION ALL VALUES ('board', '待分类', '待分类'), ('category', '待分类::待分类', '待分类'), ('module', 'UNCAT-00-00', '待分类')"""


# ------------------------------------------------------------------ reports and checklists
@query
def bundle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by status and rows by table of an import."""
    found = L.import_report(artifact_queries.imported(spark, sf_dir).results)
    return found["by_status"].select(F.lit("status").alias("kind"), F.col("status").alias("name"), F.col("artifacts").alias("n")).union(
        found["tables"].select(F.lit("table"), "table_name", "rows"))


ORACLE["bundle_report"] = artifact_queries._BODY + """SELECT 'status' AS kind, status AS name, count(DISTINCT path) AS n FROM judged GROUP BY 2
UNION ALL SELECT 'table', table_name, count(*) FROM judged WHERE status = 'imported' GROUP BY 2
UNION ALL SELECT 'table', 'trace_artifacts', count(DISTINCT path) FROM judged WHERE status = 'imported' UNION ALL SELECT 'table', 'trace_batches', 1"""


@query
def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist of an extraction whose chunks are the documents."""
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("source_document"), F.when(F.col("doc_id") % 4 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("entities"))
    out = Q.extraction_checklist(Q.chunk_summary(chunks), Q.atom_summary(order_rules(spark, sf_dir)), Q.label_summary(classified_orders(spark, sf_dir)))
    return out.select("key", F.round("value", 9).alias("value"), "status")


ORACLE["extraction_checks"] = CLASSIFIED + """,
c AS (SELECT count(*) FILTER (doc_id % 4 = 0) / count(*) AS e FROM documents), a AS (SELECT count(*) AS n, count(*) FILTER (is_ambiguous = 'true') / count(*) AS b FROM atoms),
l AS (SELECT count(codes) / count(*) AS f FROM atoms LEFT JOIN labels USING (atom_id))
SELECT 'extract_phase1_presence' AS key, round(e, 9) AS value, CASE WHEN e >= 0.3 THEN 'pass' ELSE 'warn' END AS status FROM c
UNION ALL SELECT 'extract_atoms_presence', CAST(n AS DOUBLE), CASE WHEN n > 0 THEN 'pass' ELSE 'warn' END FROM a
UNION ALL SELECT 'extract_atoms_ambiguity', round(b, 9), CASE WHEN b <= 0.25 THEN 'pass' ELSE 'warn' END FROM a
UNION ALL SELECT 'extract_classified_coverage', round(f, 9), CASE WHEN f >= 0.7 THEN 'pass' ELSE 'warn' END FROM l"""


# ------------------------------------------------------------------ traces
KINDED = f"SELECT artifact_id, batch_id, CASE artifact_type WHEN '1-URGENT' THEN 'classified_atoms' ELSE 'legal_atoms' END AS artifact_type, artifact_name, created_at FROM ({ARTIFACTS})"
SCENES = "SELECT l_orderkey AS artifact_id, 'P' || CAST(l_partkey AS STRING) AS atom_id, l_returnflag || l_linestatus AS scene_key, CAST(l_quantity AS INT) AS score FROM {lineitem}"
REPORTS = "SELECT o_orderkey * 3 AS report_id, o_orderkey AS artifact_id, o_orderpriority AS question, o_orderstatus AS final_decision FROM {orders} WHERE o_orderstatus = 'P'"


@query
def atom_scene_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").filter(F.col("p_size") == 11).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("atom_id"))
    out = L.scene_trace(derive(spark, sf_dir, SCENES), derive(spark, sf_dir, KINDED), derive(spark, sf_dir, BATCHES), wanted)
    return out.select("atom_id", "scene_key", "score", "artifact_name", "batch_label")


ORACLE["atom_scene_trace"] = f"""SELECT atom_id, scene_key, score, artifact_name, batch_label FROM ({ansi(SCENES)}) s JOIN ({ansi(KINDED)}) a USING (artifact_id) JOIN ({ansi(BATCHES)}) b ON a.batch_id = b.batch_id
WHERE atom_id IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 11)"""


@query
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.report_list(derive(spark, sf_dir, REPORTS), derive(spark, sf_dir, KINDED), derive(spark, sf_dir, BATCHES))
    return out.select("report_id", "question", "final_decision", "artifact_name", "batch_label")


ORACLE["report_list"] = f"""SELECT report_id, question, final_decision, artifact_name, batch_label FROM ({ansi(REPORTS)}) r JOIN ({ansi(KINDED)}) a USING (artifact_id) JOIN ({ansi(BATCHES)}) b ON a.batch_id = b.batch_id
ORDER BY report_id DESC LIMIT 30"""


@query
def report_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of every report of urgent orders: the order lines are the rounds."""
    reports = derive(spark, sf_dir, REPORTS)
    rounds = derive(spark, sf_dir, "SELECT l_orderkey AS artifact_id, l_linenumber AS round_index, CAST(l_quantity AS INT) AS input_atom_count FROM {lineitem}")
    return L.report_rounds(reports, rounds, reports.filter("question = '1-URGENT'").select("report_id"))


ORACLE["report_rounds"] = f"""SELECT l_orderkey AS artifact_id, l_linenumber AS round_index, CAST(l_quantity AS INTEGER) AS input_atom_count FROM lineitem
WHERE l_orderkey IN (SELECT artifact_id FROM ({ansi(REPORTS)}) WHERE question = '1-URGENT')"""


@query
def batch_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of the classified artifacts of one market segment's batches."""
    atoms = derive(spark, sf_dir, "SELECT l_orderkey AS artifact_id, 'P' || CAST(l_partkey AS STRING) AS atom_id, l_returnflag AS rule_type FROM {lineitem}")
    batches = derive(spark, sf_dir, BATCHES).filter("notes = 'BUILDING'")
    return L.classified_of(atoms, derive(spark, sf_dir, KINDED), batches).groupBy("batch_id", "rule_type").agg(F.count("*").alias("atoms"))


ORACLE["batch_atoms"] = f"""SELECT batch_id, l_returnflag AS rule_type, count(*) AS atoms FROM lineitem JOIN ({ansi(KINDED)}) a ON l_orderkey = artifact_id
WHERE artifact_type = 'classified_atoms' AND batch_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2"""

"""Queries for instrument checks, decisions, lineage, review and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.operators import decisions as D, instruments as I, lineage as L, quality as Q
from rulegrain.plans.corpus import ORDER_RULES, ansi, derive, table
from rulegrain.plans.graph_queries import CLASSIFIED, MATCHES, classified_orders, order_matches, order_rules

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ instrument checks
DIGIT = "substr('壹贰叁肆伍陆柒捌玖', CAST({} AS INT), 1)"
MONTH, DAY = "EXTRACT(MONTH FROM o_orderdate)", "EXTRACT(DAY FROM o_orderdate)"
MONTH_TEXT = f"CASE WHEN {MONTH} < 10 THEN '零' || {DIGIT.format(MONTH)} WHEN {MONTH} = 10 THEN '壹拾' ELSE '壹拾' || {DIGIT.format(MONTH + ' - 10')} END || '月'"
DAY_TEXT = f"""CASE WHEN {DAY} < 10 THEN '零' || {DIGIT.format(DAY)} WHEN {DAY} = 10 THEN '壹拾' WHEN {DAY} < 20 THEN '壹拾' || {DIGIT.format(DAY + ' - 10')}
  WHEN {DAY} = 20 THEN '贰拾' WHEN {DAY} < 30 THEN '贰拾' || {DIGIT.format(DAY + ' - 20')} WHEN {DAY} = 30 THEN '叁拾' ELSE '叁拾壹' END || '日'"""
PAYLOADS = f"""
SELECT o_orderkey AS payload_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS issue_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 20 AS INT) AS STRING) AS core_date,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '三月一日' ELSE ({MONTH_TEXT}) || ({DAY_TEXT}) END AS issue_date_chinese,
  CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN '￥' || CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS STRING)
       ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN '￥1,680.32' ELSE '1000' END END AS amount_numeric,
  CASE o_orderpriority WHEN '1-URGENT' THEN '人民币壹仟陆佰捌拾元零叁角贰分' WHEN '2-HIGH' THEN '人民币壹仟元整' WHEN '3-MEDIUM' THEN ''
       WHEN '4-NOT SPECIFIED' THEN '人民币壹仟元' ELSE '人民币1000元' END AS amount_upper,
  CASE WHEN o_custkey % 4 = 0 THEN '财务专用章，法人章' WHEN o_custkey % 4 = 1 THEN '公章' WHEN o_custkey % 4 = 2 THEN '经办章;签名' ELSE '' END AS signatures
FROM {{orders}}"""


@query
def instrument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.payload_checks(derive(spark, sf_dir, PAYLOADS)).select("payload_id", "sequence", "rule_id", "check_type", "status")


CHECKED = f"""WITH p AS ({ansi(PAYLOADS)}), prio AS (SELECT o_orderkey AS payload_id, o_orderpriority AS pr, o_custkey AS ck, o_orderstatus AS st FROM orders),
checks AS (
  SELECT payload_id, 1 AS sequence, 'ISSUE_DATE_WITHIN_10_DAYS' AS check_type, CASE WHEN issue_date = '' THEN 'SKIP' WHEN ck % 20 <= 10 THEN 'PASS' ELSE 'FAIL' END AS status FROM p JOIN prio USING (payload_id)
  UNION ALL SELECT payload_id, 2, 'ISSUE_DATE_IN_CHINESE_UPPERCASE', CASE WHEN issue_date = '' THEN 'SKIP' WHEN pr = '4-NOT SPECIFIED' THEN 'FAIL' ELSE 'PASS' END FROM p JOIN prio USING (payload_id)
  UNION ALL SELECT payload_id, 3, 'LOWER_AMOUNT_HAS_RMB_SYMBOL', CASE WHEN st = 'P' THEN 'SKIP' WHEN st = 'O' OR pr = '1-URGENT' THEN 'PASS' ELSE 'FAIL' END FROM prio
  UNION ALL SELECT payload_id, 4, 'UPPER_AMOUNT_EQUALS_LOWER_AMOUNT', CASE WHEN st = 'P' OR pr = '3-MEDIUM' THEN 'SKIP'
     WHEN st <> 'O' AND pr IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED') THEN 'PASS' ELSE 'FAIL' END FROM prio
  UNION ALL SELECT payload_id, 5, 'AMOUNT_IS_REQUIRED', CASE WHEN st = 'P' THEN 'FAIL' ELSE 'PASS' END FROM prio
  UNION ALL SELECT payload_id, 6, 'UPPER_AMOUNT_FORMAT_IS_VALID', CASE WHEN pr = '3-MEDIUM' THEN 'SKIP' WHEN pr IN ('4-NOT SPECIFIED', '5-LOW') THEN 'FAIL'
     WHEN st = 'O' THEN 'FAIL' ELSE 'PASS' END FROM prio
  UNION ALL SELECT payload_id, 7, 'SIGNATURE_SET_IS_COMPLETE', CASE ck % 4 WHEN 0 THEN 'PASS' WHEN 3 THEN 'SKIP' ELSE 'FAIL' END FROM prio)
"""
ORACLE["instrument_checks"] = CHECKED + "SELECT payload_id, sequence, 'REF-00' || sequence AS rule_id, check_type, status FROM checks"


@query
def instrument_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = I.payload_summary(I.payload_checks(derive(spark, sf_dir, PAYLOADS)))
    return summary.groupBy("overall_status", "pass", "fail", "skip").agg(F.count("*").alias("payloads"))


ORACLE["instrument_summary"] = CHECKED + """, s AS (SELECT payload_id, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail,
  count(*) FILTER (status = 'SKIP') AS skip FROM checks GROUP BY 1)
SELECT CASE WHEN fail > 0 THEN 'FAIL' WHEN pass > 0 THEN 'PASS' ELSE 'SKIP' END AS overall_status, pass, fail, skip, count(*) AS payloads FROM s GROUP BY 1, 2, 3, 4"""

# ------------------------------------------------------------------ final judgement
FACTS = """
SELECT o_custkey AS query_id,
  CASE WHEN o_custkey % 13 = 0 THEN 'LLM_ERROR' WHEN o_custkey % 13 = 1 THEN 'DRY_RUN' ELSE '停止召回' END AS final_decision,
  CASE WHEN o_custkey % 5 = 0 THEN 'no_new_candidates' ELSE 'llm_stop' END AS stop_reason, o_custkey % 7 <> 0 AS can_make_final,
  CAST(sum(CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END) AS BIGINT) AS fatal_gap_count,
  CAST(sum(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS BIGINT) AS reviewable_gap_count,
  CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS prohibition_count,
  CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS exception_count,
  CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice < 90000 THEN 1 ELSE 0 END) AS BIGINT) AS missing_item_count,
  CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice < 60000 THEN 1 ELSE 0 END) AS BIGINT) AS material_signal_count,
  CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS ambiguity_count,
  CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS BIGINT) AS conditional_signal_count, CAST(count(*) AS BIGINT) AS key_basis_count
FROM {orders} GROUP BY o_custkey"""


@query
def final_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = derive(spark, sf_dir, FACTS).withColumn("has_conflicting_rules", (F.col("prohibition_count") > 0) & (F.col("exception_count") > 0))
    return D.final_judgement(facts).select("query_id", "rule_id", "conclusion", "status", "confidence", F.array_join("trace", " & ").alias("trace"))


_TESTS = {
    "upstream_llm_error": "final_decision = 'LLM_ERROR'", "dry_run_only": "final_decision = 'DRY_RUN'", "fatal_gap_blocks_case": "fatal_gap_count > 0",
    "exhausted_reviewable_gap": "stop_reason = 'no_new_candidates' AND fatal_gap_count = 0 AND reviewable_gap_count > 0",
    "not_ready_needs_more_recall": "NOT can_make_final",
    "conflicting_prohibition_and_exception": "can_make_final AND prohibition_count > 0 AND exception_count > 0",
    "prohibition_without_exception": "can_make_final AND prohibition_count > 0 AND exception_count = 0",
    "material_gap_requires_supplement": "can_make_final AND missing_item_count > 0 AND material_signal_count > 0",
    "high_ambiguity_requires_review": "can_make_final AND ambiguity_count >= 2", "reviewable_gap_requires_review": "can_make_final AND reviewable_gap_count > 0",
    "conditional_approval": "can_make_final AND conditional_signal_count > 0", "clear_approval": "can_make_final AND key_basis_count > 0",
    "fallback_manual_review": "true",
}
_RENDERED = {rule["rule_id"]: rule for rule in D.FINAL_RULES}


def _case(field) -> str:
    return "CASE " + " ".join(f"WHEN rule_id = '{name}' THEN {field(_RENDERED[name])}" for name in _TESTS) + " END"


def _trace(rule) -> str:
    parts = [D.render(item) for item in rule["all_of"]] + ([" OR ".join(D.render(item) for item in rule["any_of"])] if rule["any_of"] else [])
    return "'" + " & ".join(parts).replace("'", "''") + "'"


ORACLE["final_judgements"] = f"""
WITH facts AS ({ansi(FACTS)}), hit AS (SELECT query_id, CASE {" ".join(f"WHEN {test} THEN '{name}'" for name, test in _TESTS.items())} END AS rule_id FROM facts)
SELECT query_id, rule_id, {_case(lambda r: "'" + r["conclusion"] + "'")} AS conclusion, {_case(lambda r: "'" + r["status"] + "'")} AS status,
  CAST({_case(lambda r: str(r["confidence"]))} AS DOUBLE) AS confidence, {_case(_trace)} AS trace FROM hit"""

# ------------------------------------------------------------------ lineage
BATCHES = "SELECT c_custkey AS batch_id, c_name AS batch_label, c_mktsegment AS notes FROM {customer}"
ARTIFACTS = """SELECT o_orderkey AS artifact_id, o_custkey AS batch_id, o_orderpriority AS artifact_type, 'order-' || CAST(o_orderkey AS STRING) AS artifact_name,
  o_orderdate AS created_at, coalesce(n, 0) AS row_count FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
TRACE_ROWS = "SELECT l_orderkey AS artifact_id, 'P' || CAST(l_partkey AS STRING) AS atom_id, l_returnflag AS rule_type FROM {lineitem}"


@query
def batch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.batch_list(derive(spark, sf_dir, BATCHES), derive(spark, sf_dir, ARTIFACTS))


ORACLE["batch_list"] = f"""
SELECT b.batch_id, batch_label, notes, count(artifact_id) AS artifact_count, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows
FROM ({ansi(BATCHES)}) b LEFT JOIN ({ansi(ARTIFACTS)}) a ON a.batch_id = b.batch_id GROUP BY 1, 2, 3"""


@query
def artifact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.artifact_list(derive(spark, sf_dir, BATCHES), derive(spark, sf_dir, ARTIFACTS), 200, artifact_type="1-URGENT")
    return out.select("artifact_id", "batch_label", "artifact_name", "row_count")


ORACLE["artifact_list"] = f"""
SELECT artifact_id, batch_label, artifact_name, row_count FROM ({ansi(ARTIFACTS)}) a LEFT JOIN ({ansi(BATCHES)}) b ON a.batch_id = b.batch_id
WHERE artifact_type = '1-URGENT' ORDER BY created_at DESC, artifact_id LIMIT 200"""


@query
def atom_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").filter(F.col("p_size") == 11).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("atom_id"))
    out = L.atom_trace(derive(spark, sf_dir, TRACE_ROWS), derive(spark, sf_dir, ARTIFACTS), derive(spark, sf_dir, BATCHES), wanted)
    return out.select("atom_id", "rule_type", "artifact_name", "batch_label", F.col("created_at").cast("date").alias("created"))


ORACLE["atom_trace"] = f"""
SELECT atom_id, rule_type, artifact_name, batch_label, CAST(created_at AS DATE) AS created FROM ({ansi(TRACE_ROWS)}) t
JOIN ({ansi(ARTIFACTS)}) a USING (artifact_id) JOIN ({ansi(BATCHES)}) b ON a.batch_id = b.batch_id
WHERE atom_id IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 11)"""


@query
def import_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language are registered already; the rest is new."""
    documents = table(spark, sf_dir, "documents").select(F.col("source").alias("artifact_path"), "doc_id", "lang", F.col("text").alias("content"))
    registered = documents.filter(F.col("lang") == "en").select("artifact_path", L.content_hash("content").alias("sha1"))
    return L.new_artifacts(documents, registered).groupBy("artifact_path", "status").agg(F.count("*").alias("documents"))


ORACLE["import_once"] = """
SELECT source AS artifact_path, CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = d.source AND e.text = d.text)
  THEN 'skipped' ELSE 'imported' END AS status, count(*) AS documents FROM documents d GROUP BY 1, 2"""


@query
def business_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.business_summary(classified_orders(spark, sf_dir), order_matches(spark, sf_dir))


ORACLE["business_summary"] = MATCHES + """, n AS (SELECT a.source_document, coalesce(len(codes), 0) AS n FROM atoms a LEFT JOIN labels USING (atom_id))
SELECT count(*) AS classified_atom_count, count(*) FILTER (n > 0) AS labelled_atom_count, round(avg(n), 2) AS avg_labels_per_atom,
 count(*) FILTER (n > 1) AS multi_label_atom_count, count(DISTINCT source_document) AS document_count,
 (SELECT count(DISTINCT c) FROM (SELECT unnest(codes) AS c FROM labels)) AS module_count, (SELECT count(DISTINCT scene_key) FROM matches) AS scene_count FROM n"""


@query
def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.module_counts(classified_orders(spark, sf_dir))


ORACLE["module_counts"] = CLASSIFIED + """
SELECT code, module AS module_name, count(*) AS atom_count FROM (SELECT unnest(codes) AS code FROM labels) JOIN modules USING (code) GROUP BY 1, 2"""


@query
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scene_summary(order_matches(spark, sf_dir))


ORACLE["scene_summary"] = MATCHES + "SELECT module_code, scene_key, count(*) AS atom_count FROM matches GROUP BY 1, 2"


@query
def table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_metrics({"trace_batches": derive(spark, sf_dir, BATCHES), "trace_artifacts": table(spark, sf_dir, "orders"), "legal_atoms": table(spark, sf_dir, "lineitem")})


ORACLE["table_metrics"] = """SELECT 'trace_batches' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'trace_artifacts', count(*) FROM orders
UNION ALL SELECT 'legal_atoms', count(*) FROM lineitem"""

# ------------------------------------------------------------------ quality and review


@query
def atom_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.atom_summary(order_rules(spark, sf_dir))


ORACLE["atom_summary"] = f"""SELECT count(*) AS rows, count(DISTINCT source_document) AS doc_count, count(DISTINCT rule_type) AS rule_type_count,
 count(*) FILTER (is_ambiguous = 'true') AS ambiguous_count FROM ({ansi(ORDER_RULES)})"""


@query
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.atom_samples(order_rules(spark, sf_dir), 12)
    return out.select("atom_id", "rule_type", "group_size", "text_score")


ORACLE["diverse_sample"] = f"""
WITH a AS (SELECT atom_id, rule_type, is_ambiguous = 'true' AS f, length(what) + length(how) + length(content_original) AS s,
   count(*) OVER (PARTITION BY rule_type) AS g FROM ({ansi(ORDER_RULES)})),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_type ORDER BY g DESC, f, s DESC, atom_id) AS k FROM a)
SELECT atom_id, rule_type, g AS group_size, CAST(s AS INT) AS text_score FROM r ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, g DESC, f, s DESC, atom_id LIMIT 12"""

REVIEWS = """SELECT source AS sheet_name, lang AS sample_group, CASE WHEN quality IS NULL THEN '待判断' WHEN toxic = 1 THEN '明显错误'
  WHEN quality = 1 THEN '通过' ELSE '存疑' END AS judgement FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""


@query
def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.review_metrics(derive(spark, sf_dir, REVIEWS))


ORACLE["review_metrics"] = f"""
SELECT CASE WHEN grouping(sheet_name) = 1 THEN '合计' ELSE sheet_name END AS sheet_name, count(*) AS rows, count(*) FILTER (judgement = '待判断') AS pending,
 count(*) FILTER (judgement = '通过') AS passed, count(*) FILTER (judgement = '存疑') AS questionable, count(*) FILTER (judgement = '明显错误') AS wrong,
 count(*) FILTER (judgement <> '待判断') AS reviewed, count(*) FILTER (judgement IN ('存疑', '明显错误')) AS issue,
 count(*) FILTER (judgement <> '待判断') / count(*) AS completion_rate,
 CASE WHEN count(*) FILTER (judgement <> '待判断') > 0 THEN count(*) FILTER (judgement = '通过') / count(*) FILTER (judgement <> '待判断') END AS pass_review_rate
FROM ({ansi(REVIEWS)}) GROUP BY ROLLUP (sheet_name)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    means = Q.mean_vectors(vectors, "label", "embedding")
    return vectors.join(means, "label").select("vec_id", "label", F.round(Q.cosine("embedding", "mean"), 9).alias("score"))


SCORED = """WITH flat AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM flat GROUP BY 1, 2),
scored AS (SELECT vec_id, label, round(sum(CAST(x AS DOUBLE) * m) / sqrt(sum(CAST(x AS DOUBLE) * x) * sum(m * m)), 9) AS score FROM flat JOIN means USING (label, i) GROUP BY 1, 2)"""


@query
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round("score", 5).alias("score"), Q.grade("score").alias("grade"))


ORACLE["similarity_scores"] = SCORED + """ SELECT vec_id, round(score, 5) AS score, CASE WHEN score >= 0.85 THEN '完美 (Perfect)' WHEN score >= 0.6 THEN '良好 (Good)'
 ELSE '需人工复核 (Check)' END AS grade FROM scored"""


@query
def quality_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") == 1).alias("is_pass"))
    out = Q.quality_status(_scored(spark, sf_dir), verdicts, "vec_id", low=0.2, high=0.4)
    return out.groupBy("final_status").agg(F.count("*").alias("rows"))


ORACLE["quality_funnel"] = SCORED + """ SELECT CASE WHEN score > 0.4 THEN 'AUTO_PASS' WHEN score < 0.2 THEN 'AUTO_FAIL' WHEN quality = 1 THEN 'LLM_PASS'
 WHEN quality IS NOT NULL THEN 'LLM_FAIL' ELSE 'PENDING' END AS final_status, count(*) AS rows FROM scored LEFT JOIN labels ON doc_id = vec_id GROUP BY 1"""


@query
def lowest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lowest(_scored(spark, sf_dir), "vec_id").select("vec_id", "label", F.round("score", 5).alias("score"))


ORACLE["lowest_scores"] = SCORED + " SELECT vec_id, label, round(score, 5) AS score FROM scored ORDER BY scored.score, vec_id LIMIT 3"

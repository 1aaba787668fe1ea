"""Derived tables over the given parquet tables, in SQL both Spark and an ANSI engine can run.

``{name}`` stands for a base table. Nothing is cut: every row and every text takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulegrain.operators.scale import fill_cores
from rulegrain.session import cut_lineage

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

# Tables that grow with the data; a single-file copy of them is spread over the cores.
FACTS = {"lineitem", "orders", "documents", "conversations", "pages", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table over the base tables it names."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql}
    for name in FACTS & used.keys():
        used[name] = fill_cores(used[name])
    return spark.sql(sql, **used)


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def memo(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is planned once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A pipeline stage that later stages share: computed once per session and written out."""
    return memo(spark, sf_dir, name, lambda: cut_lineage(build()))


def ansi(sql: str) -> str:
    """The same text for the oracle, where base tables are views of that name."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


# One rule per order line: suppliers must deliver parts within a number of days.
LINE_RULES = """
SELECT 'L' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
         || '-' || CAST(l_suppkey AS STRING) AS atom_id,
       l_orderkey * 10 + l_linenumber AS row_no,
       p_type AS source_document,
       '第' || CAST(l_linenumber AS STRING) || '条' AS article_reference,
       CASE WHEN l_returnflag = 'R' THEN 'PRO_FORBIDDEN' WHEN l_returnflag = 'A' THEN 'PER_AUTH'
            WHEN l_linestatus = 'O' THEN 'DEF_SCOPE' ELSE 'VAL_THRESHOLD' END AS rule_type,
       'Supplier ' || CAST(l_suppkey AS STRING) AS who,
       p_name AS what,
       '应在' || CAST(CAST(l_quantity AS INT) AS STRING) || '日内交付'
         || CASE WHEN l_discount > 0.08 THEN '，不得转让' WHEN l_discount > 0.05 THEN '，可以延期' ELSE '' END
         || CASE WHEN l_tax > 0.07 THEN '，三十日内复核' ELSE '' END AS how,
       p_brand || ' ' || p_type AS content_original,
       '["' || p_type || ' > ' || p_brand || '"]' AS label_paths
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# Actor and object of each market segment, as rule wording (fixed values).
SEGMENT_ACTOR = """CASE c_mktsegment WHEN 'BUILDING' THEN '存款人' WHEN 'MACHINERY' THEN '出票人'
  WHEN 'AUTOMOBILE' THEN '持票人' WHEN 'HOUSEHOLD' THEN '个人客户' ELSE '开户行' END"""
SEGMENT_OBJECT = """CASE c_mktsegment WHEN 'BUILDING' THEN '基本存款账户' WHEN 'MACHINERY' THEN '转账支票'
  WHEN 'AUTOMOBILE' THEN '银行汇票' WHEN 'HOUSEHOLD' THEN '银行卡' ELSE '开户证明文件' END"""

# One rule per order, written by the customer's segment in the customer's nation.
ORDER_RULES = f"""
SELECT 'O' || CAST(o_orderkey AS STRING) AS atom_id,
       o_orderkey AS row_no,
       r_name || '管理办法' AS source_document,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE '第' || CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING) || '条' END
         AS article_reference,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'PRO_FORBIDDEN' WHEN '2-HIGH' THEN 'OBL_MANDATORY'
            WHEN '3-MEDIUM' THEN 'PER_AUTH' WHEN '4-NOT SPECIFIED' THEN 'DEF_SCOPE' ELSE 'PRC_FLOW' END AS rule_type,
       'DEFAULT' AS relation_type,
       {SEGMENT_ACTOR} || '、' || c_name AS who,
       CASE o_orderpriority WHEN '1-URGENT' THEN '当日' WHEN '2-HIGH' THEN '10日内' WHEN '3-MEDIUM' THEN '开立账户前'
            WHEN '4-NOT SPECIFIED' THEN '未指定' ELSE '每月末' END AS `when`,
       n_name AS `where`,
       {SEGMENT_OBJECT} AS what,
       CASE o_orderpriority WHEN '1-URGENT' THEN '不得转让' || n_name WHEN '2-HIGH' THEN '应当提交证明材料并审核'
            WHEN '3-MEDIUM' THEN '可以支取现金' WHEN '4-NOT SPECIFIED' THEN '是指' || c_mktsegment
            ELSE '办理流程不超过' || CAST(EXTRACT(MONTH FROM o_orderdate) AS STRING) || '日' END AS how,
       n_name || ' ' || c_mktsegment || ' ' || o_orderpriority || ' ' || c_name AS content_original,
       CASE WHEN o_orderstatus = 'P' THEN 'true' ELSE 'false' END AS is_ambiguous,
       CASE WHEN o_orderstatus = 'P' THEN 'AMBIGUOUS_TEXT' ELSE 'NONE' END AS review_reason,
       '["' || c_mktsegment || '"]' AS business_categories,
       CASE WHEN o_orderstatus = 'F' THEN '["' || o_orderpriority || '"]' ELSE '' END AS related_scenarios
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
     JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
"""

# Taxonomy rows: a header row per region, then nation (category) and segment (module) rows.
TAXONOMY_ROWS = """
SELECT r_regionkey * 100000 AS row_no, '【' || r_name || '】' AS category, '【' || r_name || '】' AS module,
       '' AS projects, '' AS remark
FROM {region}
UNION ALL
SELECT DISTINCT r_regionkey * 100000 + n_nationkey * 100 +
         CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3
              WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END AS row_no,
       n_name AS category, c_mktsegment AS module,
       c_mktsegment || ' 1-URGENT' || chr(10) || c_mktsegment || ' 2-HIGH' || chr(10) || c_mktsegment || ' 3-MEDIUM' AS projects,
       'segment of ' || n_name AS remark
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

ORACLE_LINES = """
SELECT doc_id, lang, source, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, lang, source,
             list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l
      FROM documents)
"""

# Regulation-shaped line: headings chosen by the first letter of the line.
MARKED_LINE = """CASE
  WHEN line LIKE 'T%' OR line LIKE 'E%' THEN '第' || CAST(line_no AS STRING) || '条 ' || line
  WHEN line LIKE 'A%' THEN '第一章 ' || line
  WHEN line LIKE 'L%' THEN '附' || CAST(line_no AS STRING) || ' ' || line
  WHEN line LIKE 'S%' OR line LIKE 'I%' THEN '三、' || line
  WHEN line LIKE 'N%' THEN '（二）' || line
  WHEN line LIKE 'U%' THEN '正确填写票据和结算凭证的基本规定 ' || line
  ELSE line END"""

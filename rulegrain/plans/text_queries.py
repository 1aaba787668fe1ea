"""Queries for conflicts, text preparation, containment and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.functions.numbers import numeric_signatures
from rulegrain.operators import conflicts as C, segment as S
from rulegrain.operators.containment import find_terms
from rulegrain.plans.corpus import LINE_RULES, MARKED_LINE, ORACLE_LINES, ansi, derive, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ conflicts (G)
COMPARABLE = f"""
WITH atoms AS ({ansi(LINE_RULES)}),
comparable AS (
  SELECT *, replace(who, ' ', '') || '|' || replace(what, ' ', '') AS scope_key,
         CASE WHEN how LIKE '%不得%' THEN 'forbid' WHEN how LIKE '%可以%' THEN 'allow'
              WHEN rule_type = 'PRO_FORBIDDEN' THEN 'forbid' WHEN rule_type = 'PER_AUTH' THEN 'allow' ELSE 'neutral' END AS polarity,
         list_distinct(list_concat(regexp_extract_all(how, '\\d+日', 0),
                                   CASE WHEN how LIKE '%三十日%' THEN ['30日'] ELSE [] END)) AS signatures
  FROM atoms WHERE rule_type <> 'DEF_SCOPE' AND length(replace(what, ' ', '')) >= 4),
sigs AS (SELECT scope_key, count(*) AS n, list(s ORDER BY s)[1:5] AS firsts
         FROM (SELECT DISTINCT scope_key, unnest(signatures) AS s FROM comparable) GROUP BY scope_key),
grouped AS (
  SELECT c.scope_key, count(*) AS rule_count, count(*) FILTER (polarity = 'forbid') AS fb, count(*) FILTER (polarity = 'allow') AS al,
         count(DISTINCT source_document) AS document_count, count(DISTINCT label_paths) AS label_count,
         first(who ORDER BY row_no, atom_id) AS subject, first(what ORDER BY row_no, atom_id) AS item,
         min(row_no) AS first_no, first(atom_id ORDER BY row_no, atom_id) AS first_atom, any_value(sigs.n) AS n_sig, any_value(sigs.firsts) AS firsts
  FROM comparable c LEFT JOIN sigs ON sigs.scope_key = c.scope_key GROUP BY c.scope_key HAVING count(*) >= 2),
found AS (
  SELECT *, 1 AS kind, '禁止/允许并存' AS conflict_type, '高' AS risk_level, '{C.POLARITY_REASON}' AS reason FROM grouped WHERE fb > 0 AND al > 0
  UNION ALL
  SELECT *, 2, '阈值口径不一致', '中', '{C.THRESHOLD_REASON.split("{}")[0]}' || array_to_string(firsts, ' / ') || '{C.THRESHOLD_REASON.split("{}")[1]}'
  FROM grouped WHERE n_sig >= 2),
numbered AS (SELECT *, 'CF-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS STRING), 4, '0') ELSE CAST(n AS STRING) END AS conflict_id
  FROM (SELECT *, row_number() OVER (ORDER BY first_no, first_atom, kind) AS n FROM found))
"""


def _line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparable_atoms(derive(spark, sf_dir, LINE_RULES))


@query
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflict_groups(C.number_conflicts(_line_rules(spark, sf_dir)))


ORACLE["conflict_groups"] = COMPARABLE + """
SELECT conflict_id, conflict_type, risk_level, subject, item, rule_count, document_count, label_count, reason,
       CASE WHEN risk_level = '高' THEN 1 ELSE 2 END AS risk_rank FROM numbered"""


@query
def conflict_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _line_rules(spark, sf_dir)
    return C.conflict_details(rules, C.number_conflicts(rules))


ORACLE["conflict_details"] = COMPARABLE + """
SELECT conflict_id, conflict_type, risk_level, atom_id, rule_type, source_document, article_reference, who, what, how,
       json_extract_string(label_paths, '$[0]') AS business_label_paths
FROM comparable c JOIN numbered n ON c.scope_key = n.scope_key"""


@query
def conflict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _line_rules(spark, sf_dir)
    return C.conflict_summary(rules, C.number_conflicts(rules))


ORACLE["conflict_summary"] = COMPARABLE + """
SELECT (SELECT count(*) FROM numbered) AS group_count, (SELECT count(*) FROM numbered WHERE risk_level = '高') AS high_count,
       (SELECT count(*) FROM numbered WHERE risk_level = '中') AS medium_count,
       (SELECT count(DISTINCT atom_id) FROM comparable WHERE scope_key IN (SELECT scope_key FROM numbered)) AS affected_atom_count"""


@query
def polarity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_rules(spark, sf_dir).groupBy("rule_type", "polarity").agg(
        F.count("*").alias("rules"), F.countDistinct("source_document").alias("documents")
    )


ORACLE["polarity_distribution"] = COMPARABLE + """
SELECT rule_type, polarity, count(*) AS rules, count(DISTINCT source_document) AS documents FROM comparable GROUP BY 1, 2"""


@query
def signature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = derive(spark, sf_dir, LINE_RULES)
    return (
        rules.select("source_document", F.explode(numeric_signatures("how")).alias("signature"))
        .groupBy("source_document", "signature").agg(F.count("*").alias("rules"))
    )


ORACLE["signature_counts"] = f"""
WITH atoms AS ({ansi(LINE_RULES)})
SELECT source_document, s AS signature, count(*) AS rules
FROM (SELECT source_document, unnest(list_distinct(list_concat(regexp_extract_all(how, '\\d+日', 0),
        CASE WHEN how LIKE '%三十日%' THEN ['30日'] ELSE [] END))) AS s FROM atoms) GROUP BY 1, 2"""


# ------------------------------------------------------------------ lines, chunks, segments (B)
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lines = S.document_lines(documents, "doc_id", "text")
    return lines


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("line", F.expr(MARKED_LINE))


MARKED = f"WITH lines AS ({ORACLE_LINES}), marked AS (SELECT doc_id, line_no, {MARKED_LINE} AS line FROM lines)"


@query
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.md5("line").alias("line_hash"))


ORACLE["document_lines"] = f"SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(line) AS line_hash FROM ({ORACLE_LINES})"

CHUNK_START = "^[A-Z][a-z]{1,3} "


@query
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chunks = S.chunk_documents(documents, "doc_id", "text", article=CHUNK_START)
    return chunks.select("doc_id", "chunk_index", F.length("content_original").alias("n_chars"), F.md5("content_original").alias("chunk_hash"))


ORACLE["document_chunks"] = f"""
WITH RECURSIVE src AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
walk AS (
  SELECT doc_id, 0 AS pos, CAST(0 AS BIGINT) AS len, 1 AS chunk FROM src
  UNION ALL
  SELECT w.doc_id, w.pos + 1,
         CASE WHEN (regexp_matches(s.l[w.pos + 1], '{CHUNK_START}') AND w.len > 300) OR w.len + length(s.l[w.pos + 1]) > 1000
              THEN length(s.l[w.pos + 1]) ELSE w.len + length(s.l[w.pos + 1]) END,
         CASE WHEN (regexp_matches(s.l[w.pos + 1], '{CHUNK_START}') AND w.len > 300) OR w.len + length(s.l[w.pos + 1]) > 1000
              THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN src s ON s.doc_id = w.doc_id WHERE w.pos < len(s.l)),
placed AS (SELECT w.doc_id, w.chunk, w.pos, s.l[w.pos] AS line FROM walk w JOIN src s ON s.doc_id = w.doc_id WHERE w.pos > 0),
texts AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY pos) AS content FROM placed GROUP BY doc_id, chunk
          UNION ALL SELECT doc_id, 1, '' FROM placed WHERE pos = 1 AND chunk = 2)
SELECT doc_id, chunk AS chunk_index, CAST(length(content) AS INT) AS n_chars, md5(content) AS chunk_hash FROM texts"""


@query
def article_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.article_segments(_marked(spark, sf_dir), "doc_id")
    return out.select("id", F.col("doc").alias("doc_id"), "ref", "type", F.md5("text").alias("text_hash"), "seg_ord", "part")


ORACLE["article_segments"] = MARKED + """,
heads AS (SELECT *, regexp_matches(line, '^第[0-9]+条') AS is_article, regexp_matches(line, '^第一章') AS is_section FROM marked),
islands AS (SELECT *, sum(CASE WHEN is_article OR is_section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM heads),
kept AS (SELECT doc_id, island, regexp_extract(first(line ORDER BY line_no), '^(第[0-9]+条)', 1) AS ref, min(line_no) AS seg_ord,
                list(line ORDER BY line_no) AS ls FROM islands WHERE island > 0 GROUP BY 1, 2 HAVING bool_or(is_article)),
blocks AS (SELECT doc_id || ':' || ref || ':BLOCK' AS id, doc_id, ref, 'article_block' AS type, array_to_string(ls, chr(10)) AS text, seg_ord, 0 AS part FROM kept),
paras AS (SELECT doc_id, ref, seg_ord, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS text FROM kept)
SELECT id, doc_id, ref, type, md5(text) AS text_hash, CAST(seg_ord AS INT) AS seg_ord, CAST(part AS INT) AS part FROM (
  SELECT * FROM blocks UNION ALL
  SELECT doc_id || ':' || ref || ':P' || p, doc_id, ref || '#P' || p, 'article_paragraph', text, seg_ord, p FROM paras)"""


@query
def payment_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.payment_segments(_marked(spark, sf_dir), "doc_id", stop="附9")
    return out.groupBy("type").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("doc").alias("documents"))


ORACLE["payment_segments"] = MARKED + """,
titled AS (SELECT doc_id, min(line_no) AS t FROM marked WHERE line LIKE '正确填写%' GROUP BY 1),
placed AS (SELECT m.*, t FROM marked m LEFT JOIN titled USING (doc_id)),
body AS (SELECT * FROM placed WHERE t IS NULL OR line_no < t),
heads AS (SELECT *, regexp_matches(line, '^第[0-9]+条') AS is_article, regexp_matches(line, '^第一章') AS is_section FROM body),
islands AS (SELECT *, sum(CASE WHEN is_article OR is_section THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM heads),
arts AS (SELECT doc_id, island, list(line ORDER BY line_no) AS ls FROM islands WHERE island > 0 GROUP BY 1, 2 HAVING bool_or(is_article)),
stops AS (SELECT doc_id, min(line_no) AS s FROM placed WHERE line_no >= t AND line LIKE '附9%' GROUP BY 1),
tail AS (SELECT p.* FROM placed p LEFT JOIN stops USING (doc_id) WHERE line_no >= t AND (s IS NULL OR line_no < s) AND line NOT LIKE '正确填写%'),
tisl AS (SELECT *, sum(CASE WHEN line LIKE '三、%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM tail),
items AS (SELECT doc_id, island, string_agg(line, chr(10) ORDER BY line_no) AS text FROM tisl WHERE island > 0 GROUP BY 1, 2),
allsegs AS (
  SELECT 'article_block' AS type, doc_id, array_to_string(ls, chr(10)) AS text FROM arts
  UNION ALL SELECT 'article_paragraph', doc_id, unnest(ls) FROM arts
  UNION ALL SELECT 'appendix_item', doc_id, text FROM items
  UNION ALL SELECT 'appendix_subitem', doc_id, line FROM tisl WHERE island > 0 AND line LIKE '（二）%')
SELECT type, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT doc_id) AS documents FROM allsegs GROUP BY type"""


@query
def legal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.legal_segments(_marked(spark, sf_dir), "doc_id")
    return out.select(F.col("doc").alias("doc_id"), "ref", "seg_ord", F.md5("text").alias("text_hash"))


ORACLE["legal_segments"] = MARKED + """,
kinds AS (SELECT *, CASE WHEN line LIKE '正确填写%' THEN 'title' WHEN regexp_matches(line, '^附[0-9]+') THEN 'header'
   WHEN regexp_matches(line, '^第[0-9]+条') THEN 'article' WHEN line LIKE '第一章%' THEN 'section' WHEN line LIKE '三、%' THEN 'item' END AS kind FROM marked),
sets AS (SELECT *, CASE kind WHEN 'title' THEN '附一' WHEN 'header' THEN regexp_extract(line, '^(附[0-9]+)', 1) WHEN 'article' THEN '' END AS sets_app FROM kinds),
carried AS (SELECT *, last_value(sets_app IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS app FROM sets),
marks AS (SELECT *, CASE WHEN kind = 'header' THEN sets_app WHEN kind = 'article' THEN regexp_extract(line, '^(第[0-9]+条)', 1)
   WHEN kind IN ('section', 'title') THEN '' WHEN kind = 'item' AND coalesce(app, '') <> '' THEN app || '-三' END AS mark FROM carried),
isl AS (SELECT *, sum(CASE WHEN mark IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM marks)
SELECT doc_id, max(mark) AS ref, CAST(min(line_no) AS INT) AS seg_ord, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_hash
FROM isl WHERE island > 0 GROUP BY doc_id, island HAVING max(mark) <> ''"""


# ------------------------------------------------------------------ containment
def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[\s,.]+")).alias("term"))
    return words.filter(F.length("term") > 0).distinct()


ORACLE_WORDS = "SELECT DISTINCT t AS term FROM (SELECT unnest(regexp_split_to_array(text, '[\\s,.]+')) AS t FROM benchmark) WHERE length(t) > 0"


@query
def dictionary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_terms(documents, "text", benchmark_words(spark, sf_dir), "term").groupBy("term").agg(F.count("*").alias("documents"))


ORACLE["dictionary_hits"] = f"""
SELECT term, count(*) AS documents FROM documents JOIN ({ORACLE_WORDS}) ON contains(text, term) GROUP BY term"""

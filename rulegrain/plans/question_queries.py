"""Queries for alignment, entity records, question answering and evidence recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.functions import vocab as V
from rulegrain.operators import align as A, decisions as D, entities as N, qa as Q, recall as R, segment as S, taxonomy as X
from rulegrain.operators.scale import fill_cores
from rulegrain.plans.corpus import ORACLE_LINES, ORDER_RULES, SEGMENT_ACTOR, SEGMENT_OBJECT, ansi, derive, memo, stored, table
from rulegrain.plans.graph_queries import MATCHES, MODULES, classified_orders, modules_of, order_links, order_matches, order_rules

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ alignment (K1-K5)
LIBRARY = "library"  # lines of every language are compared with the same clauses


def line_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fill_cores(table(spark, sf_dir, "documents"))
    lines = S.document_lines(documents, "doc_id", "text")
    return lines.select(F.concat_ws("-", "doc_id", "line_no").alias("atom_id"), F.lit(LIBRARY).alias("source_document"), F.col("line").alias("content_original"), "line_no", "doc_id")


def benchmark_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("clause_no"), F.concat(F.lit("S"), F.col("item_id")).alias("segment_id"), F.lit("R").alias("rule_id"),
        F.lit(LIBRARY).alias("document_name"), F.col("text").alias("matched_segment_text"))


NORM = "translate(regexp_replace({}, '\\s+', '', 'g'), 'Oo，,。；;：:“”\"''‘’（）()【】[]—-', '00')"
OVERLAP = """CASE WHEN {l} = '' OR {r} = '' THEN 0.0 ELSE least(1.0, len(list_filter(string_split({l}, ''), lambda ch: contains({r}, ch))) / length({l}) * 0.8
  + CASE WHEN contains({l}, {r}) OR contains({r}, {l}) THEN 0.2 ELSE 0.0 END) END"""
ALIGN = f"""WITH lines AS ({ORACLE_LINES}),
a AS (SELECT doc_id || '-' || line_no AS atom_id, {NORM.format('line')} AS n FROM lines),
c AS (SELECT item_id, {NORM.format('text')} AS cn FROM benchmark)"""


@query
def sample_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.sample_links(line_atoms(spark, sf_dir), benchmark_clauses(spark, sf_dir))
    return out.select("atom_id", "segment_id", "score", "rank")


ORACLE["sample_links"] = ALIGN + f""", scored AS (SELECT atom_id, item_id, {OVERLAP.format(l='n', r='cn')} AS s FROM a, c)
SELECT atom_id, 'S' || item_id AS segment_id, round(s, 4) AS score, CAST(r AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY s DESC, item_id) AS r FROM scored WHERE s >= 0.45) WHERE r <= 3"""


@query
def aligned_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = benchmark_clauses(spark, sf_dir).select("segment_id", F.col("document_name").alias("doc"), F.col("matched_segment_text").alias("text"))
    out = A.align_atoms(segments, line_atoms(spark, sf_dir))
    return out.groupBy("segment_id").agg(F.count("*").alias("atoms"), F.round(F.max("score"), 6).alias("best"))


ORACLE["aligned_atoms"] = ALIGN + f""", scored AS (SELECT atom_id, item_id, n <> '' AND (contains(n, cn) OR contains(cn, n)) AS hit, {OVERLAP.format(l='cn', r='n')} AS s FROM a, c),
flagged AS (SELECT *, bool_or(hit) OVER (PARTITION BY item_id) AS any_hit FROM scored)
SELECT 'S' || item_id AS segment_id, count(*) AS atoms, round(max(s), 6) AS best FROM flagged WHERE hit OR (NOT any_hit AND s >= 0.45) GROUP BY item_id"""


@query
def resolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host that each page's address names."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", "//([^/]+)", 1).alias("document")).distinct()
    return A.resolve_documents(pages.select(F.col("url").alias("source_document")), hosts)


_FORM = "translate(regexp_replace(url, '\\s+', '', 'g'), '" + V.DOC_NAME_PUNCTUATION.replace("'", "''") + "', '')"
ORACLE["resolved_documents"] = f"""WITH c AS (SELECT DISTINCT url, {_FORM} AS a FROM pages), d AS (SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS host FROM pages),
h AS (SELECT host, {_FORM.replace('url', 'host')} AS b FROM d),
s AS (SELECT url, host, CASE WHEN contains(b, a) THEN length(a) ELSE 0 END + CASE WHEN contains(a, b) THEN length(b) ELSE 0 END
  + len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) AS score FROM c, h)
SELECT url AS source_document, host AS document, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, host) AS r FROM s WHERE score > 3) WHERE r = 1"""


@query
def matched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_atoms(spark, sf_dir)
    segments = lines.select(F.col("atom_id").alias("segment_id"), F.col("source_document").alias("doc"), F.concat(F.lit("第"), "line_no", F.lit("条")).alias("ref"),
                            F.col("content_original").alias("text"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("seg_ord"))
    hint = F.when(F.col("item_id") < 20, F.concat(F.lit("第"), F.col("item_id").cast("string"), F.lit("条"))).otherwise("")
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.lit(LIBRARY).alias("doc"), F.concat(hint, F.col("text")).alias("chunk"))
    return A.match_chunks(chunks, segments).select("chunk_id", "segment_id", "match_score")


ORACLE["matched_chunks"] = f"""WITH lines AS ({ORACLE_LINES}),
seg AS (SELECT doc_id || '-' || line_no AS segment_id, '第' || line_no || '条' AS ref, doc_id * 100000 + line_no AS ord, {NORM.format('line')} AS n FROM lines),
ch AS (SELECT item_id, CASE WHEN item_id < 20 THEN '第' || item_id || '条' END AS hint, {NORM.format("CASE WHEN item_id < 20 THEN '第' || item_id || '条' ELSE '' END || text")} AS cn FROM benchmark),
h AS (SELECT ch.*, EXISTS (SELECT 1 FROM seg WHERE starts_with(ref, hint)) AS known FROM ch),
scored AS (SELECT item_id, segment_id, ord, {OVERLAP.format(l='cn', r='n')} AS s FROM h JOIN seg ON NOT coalesce(known, false) OR hint IS NULL OR starts_with(ref, hint))
SELECT item_id AS chunk_id, segment_id, round(s, 4) AS match_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, ord) AS r FROM scored) WHERE r = 1"""

# ------------------------------------------------------------------ entities (C)
ALIAS_PAIRS = [("主体别称", "储户", "存款人"), ("主体别称", "开户行", "开户银行"), ("机构简称", "人行", "中国人民银行"), ("主体别称", "客户", "个人客户"),
               ("账户简称", "基本户", "基本存款账户"), ("账户简称", "支票户", "转账支票"), ("法规简称", "银票", "银行汇票")]


_KNOWN: dict = {}


def dictionaries(spark: SparkSession, sf_dir: str) -> Q.Dictionaries:
    """Alias pairs given as vocabulary, actor and object words read from the data; stored once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        pairs = spark.createDataFrame(ALIAS_PAIRS, "category string, alias string, canonical string")
        words = stored(spark, sf_dir, "segment_words", lambda: derive(spark, sf_dir, f"SELECT DISTINCT {SEGMENT_ACTOR} AS actor, {SEGMENT_OBJECT} AS object FROM {{customer}}"))
        _KNOWN[key] = Q.Dictionaries(
            words.select(F.col("actor").alias("term")), N.alias_index(pairs, V.ACTOR_CATEGORIES), N.alias_index(pairs, V.OBJECT_CATEGORIES),
            words.select(F.col("object").alias("term")))
    return _KNOWN[key]


@query
def actor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = order_rules(spark, sf_dir)
    raw = N.without_whole(N.actor_terms("who"), "who")
    out = N.actor_records(atoms, "atom_id", "who", raw, dictionaries(spark, sf_dir).actor_index)
    return out.groupBy("record.name", "record.is_normalized").agg(F.count("*").alias("atoms"))


ORACLE["actor_records"] = f"""
WITH p AS (SELECT string_split(who, '、')[1] AS a, string_split(who, '、')[2] AS b FROM ({ansi(ORDER_RULES)})),
n AS (SELECT CASE a WHEN '开户行' THEN '开户银行' ELSE a END AS name, a IN ('开户行', '存款人', '个人客户') AS is_normalized FROM p UNION ALL SELECT b, false FROM p)
SELECT name, is_normalized, count(*) AS atoms FROM n GROUP BY 1, 2"""


@query
def object_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = dictionaries(spark, sf_dir)
    out = N.object_records(order_rules(spark, sf_dir), "atom_id", "what", N.object_terms("what"), known.object_index, known.object_terms)
    return out.groupBy("record.name", "record.is_normalized").agg(F.count("*").alias("atoms"))


ORACLE["object_records"] = f"""
SELECT what AS name, what IN ('基本存款账户', '转账支票', '银行汇票') AS is_normalized, count(*) AS atoms FROM ({ansi(ORDER_RULES)})
WHERE what <> '银行卡' OR true GROUP BY 1, 2"""


@query
def time_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.time_records(order_rules(spark, sf_dir), "atom_id", "when", N.without_whole(N.time_terms("when"), "when"), None)
    return out.groupBy("record.name", "record.is_normalized").agg(F.count("*").alias("atoms"))


ORACLE["time_records"] = f"""
SELECT CASE "when" WHEN '开立账户前' THEN '开立账户前' ELSE "when" END AS name, true AS is_normalized, count(*) AS atoms FROM ({ansi(ORDER_RULES)})
WHERE "when" <> '未指定' GROUP BY 1, 2"""

# ------------------------------------------------------------------ question answering (H)
QUESTIONS = f"""
SELECT CAST(c_custkey AS STRING) AS query_id,
  CASE c_custkey % 5 WHEN 0 THEN {SEGMENT_ACTOR} || '开立' || {SEGMENT_OBJECT} || '需要提交哪些证明材料'
    WHEN 1 THEN '谁负责办理' || {SEGMENT_OBJECT} WHEN 2 THEN {SEGMENT_OBJECT} || '是指什么'
    WHEN 3 THEN {SEGMENT_ACTOR} || '可以用' || {SEGMENT_OBJECT} || '支取现金吗' ELSE '是否可以、如何办理' || {SEGMENT_OBJECT} END AS question,
  '' AS query, '' AS who
FROM {{customer}}"""


@query
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, QUESTIONS)
    typed = rows.select(Q.question_type(F.col("question")).alias("question_type"), Q.several_intents(F.col("question")).alias("several"))
    return typed.groupBy("question_type", "several").agg(F.count("*").alias("questions"))


ORACLE["question_types"] = f"""
SELECT CASE WHEN question LIKE '%谁负责%' THEN 'B' WHEN question LIKE '%是指%' THEN 'C' ELSE 'A' END AS question_type,
       question LIKE '%、%' AS several, count(*) AS questions FROM ({ansi(QUESTIONS)}) GROUP BY 1, 2"""


def _links(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Names of the order rules per kind, stored once; pairs may repeat."""
    named = lambda rows: lambda: rows.select("atom_id", "record.name", "record.normalized_name")
    return {kind: stored(spark, sf_dir, f"links-{kind}", named(rows)) for kind, rows in order_links(spark, sf_dir).items()}


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: Q.answer_questions(
        derive(spark, sf_dir, QUESTIONS), order_rules(spark, sf_dir), _links(spark, sf_dir), order_matches(spark, sf_dir), dictionaries(spark, sf_dir))
    return memo(spark, sf_dir, "answered", build)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found(told: DataFrame) -> DataFrame:
        read = Q.with_question_terms(told, dictionaries(spark, sf_dir))
        return Q.retrieve(read, order_rules(spark, sf_dir), _links(spark, sf_dir), order_matches(spark, sf_dir)).join(read.select("query_id", "question", "search_text"), "query_id")

    return memo(spark, sf_dir, "candidates", lambda: Q.once_per_question(derive(spark, sf_dir, QUESTIONS), found))


@query
def question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _candidates(spark, sf_dir)
    return out.select("query_id", "atom_id", "rank", "match_count", "has_scene_match", "answer_actor", "answer_object")


_CANDIDATES = MATCHES + f""", q AS (SELECT query_id, question, {SEGMENT_ACTOR} AS actor, {SEGMENT_OBJECT} AS object
  FROM ({ansi(QUESTIONS)}) JOIN customer ON query_id = CAST(c_custkey AS STRING)
  WHERE question NOT LIKE '%谁负责%' AND question NOT LIKE '%是指%' AND contains(question, {SEGMENT_ACTOR}) AND {SEGMENT_ACTOR} <> '开户行'),
qpool AS (SELECT a.*, string_split(who, '、')[1] AS actor, a.atom_id IN (SELECT atom_id FROM matches) AS sc FROM atoms a
  WHERE rule_type IN ('OBL_MANDATORY', 'OBL_ONGOING', 'PRO_FORBIDDEN', 'PER_AUTH', 'PRC_FLOW')),
qranked AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY sc DESC, source_document, article_reference, atom_id) AS r FROM qpool),
qbc AS (SELECT query_id, question, {SEGMENT_OBJECT} AS object FROM ({ansi(QUESTIONS)}) JOIN customer ON query_id = CAST(c_custkey AS STRING)),
qb AS (SELECT * FROM qbc WHERE question LIKE '%谁负责%'), qc AS (SELECT * FROM qbc WHERE question LIKE '%是指%' AND question NOT LIKE '%谁负责%'),
bpool AS (SELECT a.*, a.atom_id IN (SELECT atom_id FROM matches) AS sc, unnest([CASE string_split(who, '、')[1] WHEN '开户行' THEN '开户银行' ELSE string_split(who, '、')[1] END, string_split(who, '、')[2]]) AS answer_actor
  FROM atoms a WHERE rule_type IN ({", ".join(f"'{x}'" for x in V.TYPE_B_RULE_TYPES)})),
branked AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY sc DESC, source_document, article_reference, answer_actor, atom_id) AS r FROM bpool),
cranked AS (SELECT a.*, a.atom_id IN (SELECT atom_id FROM matches) AS sc,
  row_number() OVER (PARTITION BY what ORDER BY a.atom_id IN (SELECT atom_id FROM matches) DESC, source_document, article_reference, what, atom_id) AS r
  FROM atoms a WHERE rule_type IN ({", ".join(f"'{x}'" for x in V.TYPE_C_RULE_TYPES)})),
picked AS (SELECT query_id, atom_id, CAST(r AS INT) AS rank, 2 AS match_count, sc AS has_scene_match, '' AS answer_actor, '' AS answer_object FROM q JOIN qranked p ON p.actor = q.actor AND p.what = q.object WHERE r <= 13
UNION ALL SELECT query_id, atom_id, CAST(r AS INT), 1, sc, answer_actor, '' FROM qb JOIN branked b ON b.what = qb.object WHERE r <= 13
UNION ALL SELECT query_id, atom_id, CAST(r AS INT), 1, sc, '', what FROM qc JOIN cranked c ON c.what = qc.object WHERE r <= 13)
"""
ORACLE["question_candidates"] = _CANDIDATES + "SELECT query_id, atom_id, rank, match_count, has_scene_match, answer_actor, answer_object FROM picked"


@query
def guarded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each guard says of each candidate of each question."""
    rows = _candidates(spark, sf_dir).withColumn("a", F.struct(*Q.ATOM_FIELDS))
    q, atom = F.col("question"), F.col("a")
    return rows.select(
        "query_id", "atom_id", "answer_actor", F.array_join(Q.outside_scope(q, atom), "|").alias("outside"), Q.precise_object_ok(F.col("search_text"), atom).alias("precise"),
        Q.action_ok(q, atom).alias("action"), Q.good_citation(atom).alias("citation"), Q.material_evidence(atom).alias("material"))


def _any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{term}')" for term in terms) + ")"


def _both(column: str, other: str, terms: list[str], joint: str) -> str:
    return "(" + f" {joint} ".join(f"(contains({column}, '{term}') AND contains({other}, '{term}'))" if joint == "OR" else f"(NOT contains({column}, '{term}') OR contains({other}, '{term}'))" for term in terms) + ")"


ORACLE["guarded_candidates"] = _CANDIDATES + f""", told AS (SELECT p.query_id, p.atom_id, answer_actor, question, rule_type, article_reference,
  concat_ws(' ', who, what, "when", how, content_original, article_reference) AS said FROM picked p JOIN atoms USING (atom_id) JOIN (SELECT query_id, question FROM ({ansi(QUESTIONS)})) q ON q.query_id = p.query_id)
SELECT query_id, atom_id, answer_actor, array_to_string(list_filter([{", ".join(f"CASE WHEN {_any('said', mine)} AND NOT {_any('question', theirs)} THEN '{name}' END" for name, mine, theirs in V.CONDITION_SCOPES)}], lambda x: x IS NOT NULL), '|') AS outside,
  {_both('question', 'said', V.PRECISE_OBJECT_TERMS, 'AND')} AS precise, NOT {_any('question', V.TYPE_B_ACTION_TERMS)} OR {_both('question', 'said', V.TYPE_B_ACTION_TERMS, 'OR')} AS action,
  contains(article_reference, '条') AND NOT {_any('said', V.WEAK_EVIDENCE_TERMS)} AS citation, rule_type <> 'PER_AUTH' AND {_any('said', V.MATERIAL_ACTION_TERMS)} AND {_any('said', V.MATERIAL_OBJECT_TERMS)} AS material FROM told"""


@query
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select(
        "query_id", "question_type", "route", "fail_reason", "answer_count", F.array_join("evidence_ids", "|").alias("evidence"),
        F.array_join(F.transform(F.coalesce("answers", F.array().cast("array<struct<text:string,atom_id:string,source:string,rule_type:string,answer_actor:string,answer_object:string>>")), lambda a: a["text"]), " / ").alias("texts"))


@query
def answer_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.hit_rates(answered(spark, sf_dir), ["question_type", "fail_reason"])


# ------------------------------------------------------------------ batch recall (F)
RECALL_QUERIES = f"""
SELECT DISTINCT c_mktsegment || ' 2-HIGH' AS query_id, c_mktsegment || ' 2-HIGH::' || {SEGMENT_ACTOR} AS raw FROM {{customer}}
UNION ALL SELECT n_name, n_name FROM {{nation}}"""


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_query_specs(derive(spark, sf_dir, RECALL_QUERIES), "raw", lambda who: N.actor_terms(who))


def recall_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_orders(spark, sf_dir).withColumn("who_terms", N.actor_terms("who"))


@query
def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = modules_of(spark, sf_dir)
    out = R.recall_report(recall_queries(spark, sf_dir), recall_atoms(spark, sf_dir), modules, X.taxonomy_scenes(modules), order_matches(spark, sf_dir))
    return out.select("query_id", "query", "matched_scene_count", "broad_recall_count", "precise_recall_count", "who_refined_count",
                      F.array_join("sample_atoms", "|").alias("samples"), F.array_join(F.transform("top_precise_who_terms", lambda t: F.concat_ws("=", t["name"], t["n"])), "|").alias("who"))


ORACLE["recall_report"] = MATCHES + f""", q AS (SELECT query_id, string_split(raw, '::')[1] AS query, string_split(raw, '::')[2] AS actor FROM ({ansi(RECALL_QUERIES)})),
qs AS (SELECT query_id, scene_key, module_code FROM q JOIN scenes ON contains(scene_name, query)),
lab AS (SELECT a.*, coalesce(codes, ['UNCAT-00-00']) AS codes FROM atoms a LEFT JOIN labels USING (atom_id)),
names AS (SELECT atom_id, string_agg(module, ' ') AS ms, string_agg(category, ' ') AS cs FROM (SELECT atom_id, unnest(codes) AS code FROM labels) JOIN modules USING (code) GROUP BY 1),
broad AS (SELECT query_id, atom_id, row_no FROM q JOIN lab ON contains(content_original || ' ' || what || ' ' || how || ' ' || "where", query)
  UNION SELECT query_id, l.atom_id, row_no FROM q JOIN (lab l JOIN names n ON n.atom_id = l.atom_id) ON contains(ms || ' | ' || cs, query)
  UNION SELECT query_id, atom_id, row_no FROM (SELECT atom_id, row_no, unnest(codes) AS code FROM lab) JOIN qs ON module_code = code),
precise AS (SELECT DISTINCT query_id, atom_id FROM matches JOIN qs USING (scene_key)),
pw AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest([who, string_split(who, '、')[1], string_split(who, '、')[2]]) AS t FROM precise JOIN atoms USING (atom_id)) GROUP BY 1, 2),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, t) AS r FROM pw)
SELECT q.query_id, query, (SELECT count(*) FROM qs WHERE qs.query_id = q.query_id) AS matched_scene_count, (SELECT count(*) FROM broad b WHERE b.query_id = q.query_id) AS broad_recall_count,
 (SELECT count(*) FROM precise p WHERE p.query_id = q.query_id) AS precise_recall_count,
 CASE WHEN actor IS NOT NULL THEN (SELECT count(*) FROM precise p JOIN atoms a USING (atom_id) WHERE p.query_id = q.query_id AND contains(who, actor)) END AS who_refined_count,
 (SELECT string_agg(atom_id, '|' ORDER BY row_no, atom_id) FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_no, atom_id) AS r FROM broad) WHERE r <= 10) b WHERE b.query_id = q.query_id) AS samples,
 (SELECT string_agg(t || '=' || n, '|' ORDER BY r) FROM pr WHERE pr.query_id = q.query_id AND r <= 10) AS who FROM q"""

# ------------------------------------------------------------------ evidence loop (I)
LOOP_QUESTIONS = f"""
SELECT DISTINCT r_name || '-' || c_mktsegment AS query_id, r_name || '的' || {SEGMENT_ACTOR} || '如何办理' || {SEGMENT_OBJECT} || '，' || c_mktsegment || ' 2-HIGH 不得超过期限吗' AS question,
  c_mktsegment || '::' || {SEGMENT_ACTOR} AS raw
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey"""


def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = modules_of(spark, sf_dir)
    asked = S.parse_query_specs(derive(spark, sf_dir, LOOP_QUESTIONS), "raw", lambda who: N.actor_terms(who))
    return X.route_questions(asked.select("query_id", "question", "query", "who_terms"), modules, X.taxonomy_scenes(modules))


def article_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each regulation in order: one per year."""
    rows = order_rules(spark, sf_dir).filter(F.col("article_reference") != "").select(F.col("source_document").alias("doc"), F.col("article_reference").alias("ref")).distinct()
    return rows.withColumn("seg_no", F.regexp_extract("ref", r"(\d+)", 1).cast("int"))


def loop_result(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOOPS:
        modules = modules_of(spark, sf_dir)
        _LOOPS[key] = R.recall_loop(
            routed_questions(spark, sf_dir), recall_atoms(spark, sf_dir), modules, X.taxonomy_scenes(modules), order_matches(spark, sf_dir),
            stored(spark, sf_dir, "places", lambda: article_places(spark, sf_dir)))
    return _LOOPS[key]


_LOOPS: dict = {}


@query
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_questions(spark, sf_dir).select("query_id", F.array_join("scene_keys", "|").alias("scenes"), F.array_join("module_codes", "|").alias("modules"))


ORACLE["question_routes"] = MODULES + f""", asked AS (SELECT query_id, question, string_split(raw, '::')[1] AS query FROM ({ansi(LOOP_QUESTIONS)})),
sscore AS (SELECT query_id, scene_key, module_code, CASE WHEN contains(question, scene_name) THEN 32 ELSE 0 END + CASE WHEN contains(query, scene_name) OR contains(scene_name, query) THEN 32 ELSE 0 END AS score FROM asked, scenes),
sbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, scene_key) AS r FROM sscore WHERE score > 0) WHERE r <= 5),
mscore AS (SELECT query_id, code, CASE WHEN contains(question, module) THEN 18 ELSE 0 END + CASE WHEN contains(question, category) THEN 8 ELSE 0 END
  + 16 * len(list_filter(projects, lambda x: contains(question, x))) + CASE WHEN contains(query, module) OR contains(module, query) THEN 22 ELSE 0 END
  + 14 * len(list_filter(projects, lambda x: contains(x, query))) + coalesce((SELECT sum(score) FROM sscore s WHERE s.query_id = asked.query_id AND module_code = code), 0) AS score FROM asked, modules),
mbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS r FROM mscore WHERE score >= 18) WHERE r <= 5),
spots AS (SELECT query_id, code, min(pos) AS pos FROM (SELECT query_id, module_code AS code, r AS pos FROM sbest UNION ALL SELECT query_id, code, r + 100 FROM mbest) GROUP BY 1, 2)
SELECT query_id, coalesce((SELECT string_agg(scene_key, '|' ORDER BY r) FROM sbest b WHERE b.query_id = asked.query_id), '') AS scenes,
  coalesce((SELECT string_agg(code, '|' ORDER BY pos) FROM spots p WHERE p.query_id = asked.query_id), '') AS modules FROM asked"""


@query
def recall_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_result(spark, sf_dir)["rounds"]


@query
def recall_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_result(spark, sf_dir)["report"].select("query_id", "stop_reason", "final_decision", "can_make_final", "rule_id", "rounds", "initial_count", "final_count")


@query
def recall_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_result(spark, sf_dir)["evidence"].select("query_id", "atom_id", "rank", F.round("score", 4).alias("score"), "source_document")


@query
def recall_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = D.final_facts(R.summarise(loop_result(spark, sf_dir)).drop("rule_id"))
    out = D.final_judgement(facts)
    return out.select("query_id", "readiness", "rule_id", "conclusion", "confidence", F.size("gaps").alias("gaps"), F.size("key_basis").alias("basis"), "next_step")


@query
def capped_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive(spark, sf_dir, CANDIDATES)
    atoms = rows.select("atom_id", "source_document")
    return R.rank_candidates(rows.select("query_id", "atom_id", "score"), atoms, 20).select("query_id", "atom_id", "rank", "source_document")


CANDIDATES = """SELECT n_name AS query_id, CAST(o_orderkey AS STRING) AS atom_id, o_totalprice AS score, o_orderpriority AS source_document
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
ORACLE["capped_ranking"] = f"""WITH c AS ({ansi(CANDIDATES)}),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_document ORDER BY score DESC, atom_id) AS dr FROM c)
SELECT query_id, atom_id, CAST(r AS INT) AS rank, source_document FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id) AS r FROM d WHERE dr <= 8) WHERE r <= 20"""


@query
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = derive(spark, sf_dir, "SELECT r_name AS query_id, n_name AS term, n_nationkey AS at FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, -1 FROM {region} UNION ALL SELECT r_name, '账户', -2 FROM {region}")
    out = R.text_scores(terms, order_rules(spark, sf_dir), 3)
    return out.groupBy("query_id", "score").agg(F.count("*").alias("atoms"))


ORACLE["field_scores"] = f"""WITH t AS (SELECT r_name AS query_id, n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, r_name FROM region UNION SELECT r_name, '账户' FROM region),
h AS (SELECT query_id, atom_id, CASE WHEN contains(what, term) THEN 8 WHEN contains(how, term) THEN 7 WHEN contains("where", term) THEN 6 WHEN contains(content_original, term) THEN 5
  WHEN contains(source_document, term) THEN 3 END AS w FROM t JOIN ({ansi(ORDER_RULES)}) a ON true),
s AS (SELECT query_id, atom_id, CAST(sum(w) AS BIGINT) AS score FROM h WHERE w IS NOT NULL GROUP BY 1, 2)
SELECT query_id, score, count(*) AS atoms FROM s GROUP BY 1, 2"""


@query
def gap_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rules(spark, sf_dir).select(R.gap_type(F.concat_ws("：", "what", "how")).alias("gap_type")).groupBy("gap_type").agg(F.count("*").alias("atoms"))


ORACLE["gap_types"] = f"""
SELECT CASE WHEN how LIKE '%不得%' THEN '例外/禁止缺口' WHEN how LIKE '%是指%' THEN '定义范围缺口' WHEN how LIKE '%证明%' OR what LIKE '%证明%' THEN '材料缺口'
  WHEN how LIKE '%流程%' OR how LIKE '%审核%' THEN '流程动作缺口' ELSE '其他缺口' END AS gap_type, count(*) AS atoms FROM ({ansi(ORDER_RULES)}) GROUP BY 1"""

"""Queries for scene profiles: rules, requirements, gaps and judgements of the customers' questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.operators import decisions as D, profiles as P
from rulegrain.plans.corpus import ORDER_RULES, ansi, derive
from rulegrain.plans.question_queries import QUESTIONS, SEGMENT_ACTOR
from rulegrain.plans.table_queries import FACTS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_MATERIAL, _DUTY = "材料要求", "义务依据"
#: Profiles over the given tables: two with rules, one with requirements.
PROFILES = [
    {
        "profile_id": "opening", "scene_names": ["BUILDING", "MACHINERY"], "question_keywords": ["开立", "办理"], "min_evidence_count": 5,
        "derived_facts": [
            {"fact_id": "holder_asked", "source": "who_terms", "mode": "non_empty"},
            {"fact_id": "asks_material", "source": "question", "mode": "keyword_any", "keywords": ["材料", "证件"]},
            {"fact_id": "asks_open_material", "source": "question", "mode": "keyword_all", "keywords": ["开立", "材料"]},
            {"fact_id": "material_found", "source": "evidence", "mode": "keyword_any", "keywords": ["证明材料"]},
            {"fact_id": "holder_found", "source": "evidence", "mode": "actor_scope"},
            {"fact_id": "duty_found", "source": "evidence", "mode": "rule_type_any", "rule_types": ["OBL_MANDATORY"]},
            {"fact_id": "limit_found", "source": "evidence", "mode": "keyword_or_rule", "keywords": ["不得"], "rule_types": ["PRO_FORBIDDEN"]},
            {"fact_id": "permit_found", "source": "evidence", "mode": "rule_type_any", "rule_types": ["PER_AUTH"]},
        ],
        "rule_specs": [
            {"rule_id": "duty_rule", "priority": 70, "requires": {"any": [{"fact": "duty_found"}, {"fact": "permit_found", "gte": 1}]}, "label": _DUTY},
            {"rule_id": "material_rule", "priority": 80, "applies_if": {"fact": "asks_material", "eq": True}, "requires": {"fact": "material_found", "eq": True},
             "on_fail": {"dimension": _MATERIAL, "reason": "证据未覆盖材料清单。", "gap_type": "材料缺口", "impact_scope": "子结论阻断",
                         "recall_directions": [("D", "补材料类规则。"), ("A", "沿场景下钻。")]}},
            {"rule_id": "holder_rule", "priority": 80, "applies_if": {"fact": "holder_asked", "eq": True}, "requires": {"fact": "holder_found", "eq": True},
             "on_fail": {"dimension": "主体范围", "reason": "证据未命中该主体。", "recall_directions": [("A", "沿场景下钻主体规则。")]}},
            {"rule_id": "boundary_rule", "priority": 100, "applies_if": {"any": [{"fact": "asks_material", "eq": True}, {"not": {"fact": "holder_asked", "eq": True}}]},
             "forbids": {"all": [{"fact": "limit_found", "eq": True}, {"not": {"fact": "duty_found", "eq": True}}]},
             "exception_if": {"all": [{"fact": "permit_found", "eq": True}, {"fact": "asks_open_material", "ne": True}]},
             "on_fail": {"dimension": "例外/禁止边界", "reason": "限制性规则缺少例外边界。", "gap_type": "例外/禁止缺口", "impact_scope": "全局阻断",
                         "recall_directions": [("E", "补例外条款。"), ("F", "补上下位规范。")]}},
        ],
    },
    {"profile_id": "late", "scene_names": ["MACHINERY"], "question_keywords": ["开立"], "rule_specs": [{"rule_id": "never_first", "requires": False}]},
    {
        "profile_id": "cash", "scene_names": ["AUTO"], "question_keywords": ["现金", "是指"], "min_direct_basis_count": 2,
        "requirements": [
            {"fact_id": "actor_scope", "label": "主体范围", "mode": "actor_scope", "activate_if_who_terms": True, "reason": "缺少主体规则。", "directions": [("A", "下钻主体。")]},
            {"fact_id": "cash_use", "label": "现金支取", "question_keywords": ["现金"], "evidence_keywords": ["支取现金"], "evidence_rule_types": ["PRO_FORBIDDEN"],
             "min_evidence_hits": 2, "reason": "缺少现金规则。", "directions": [("D", "补现金规则。")]},
            {"fact_id": "definition", "label": "定义范围", "always_required": True, "evidence_rule_types": ["DEF_SCOPE"], "reason": "缺少定义。", "directions": [("D", "补定义。"), ("A", "下钻定义。")]},
        ],
    },
]
ASKED = f"""SELECT q.query_id, question, c_mktsegment AS scene_name, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN {SEGMENT_ACTOR} ELSE '监管机构' END AS actor
FROM ({QUESTIONS}) q JOIN {{customer}} ON q.query_id = CAST(c_custkey AS STRING)"""
EVIDENCE = f"SELECT CAST(o_custkey AS STRING) AS query_id, e.* FROM ({ORDER_RULES}) e JOIN {{orders}} ON row_no = o_orderkey"


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ASKED).select("query_id", "question", F.array("scene_name", F.lit(" ")).alias("scene_names"), F.array("actor").alias("who_terms"))


def customer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, EVIDENCE)


_PROFILED = f"""WITH asked AS ({ansi(ASKED)}), ev AS ({ansi(EVIDENCE)}),
prof AS (SELECT *, CASE WHEN scene_name IN ('BUILDING', 'MACHINERY') AND (question LIKE '%开立%' OR question LIKE '%办理%') THEN 'opening'
  WHEN scene_name = 'AUTOMOBILE' AND (question LIKE '%现金%' OR question LIKE '%是指%') THEN 'cash' END AS profile_id FROM asked),
f AS (SELECT p.*, actor <> '' AS holder_asked, question LIKE '%材料%' OR question LIKE '%证件%' AS asks_material, question LIKE '%开立%' AND question LIKE '%材料%' AS asks_open_material,
  coalesce(e.material_found, false) AS material_found, coalesce(e.duty_found, false) AS duty_found, coalesce(e.limit_found, false) AS limit_found, coalesce(e.permit_found, false) AS permit_found,
  actor <> '' AND coalesce(e.holder_hits, 0) > 0 AS holder_found, coalesce(e.holder_hits, 0) AS holder_hits, coalesce(e.cash_hits, 0) AS cash_hits, coalesce(e.definitions, 0) AS definitions
  FROM prof p LEFT JOIN (SELECT ev.query_id, bool_or(how LIKE '%证明材料%') AS material_found, bool_or(rule_type = 'OBL_MANDATORY') AS duty_found,
    bool_or(how LIKE '%不得%' OR rule_type = 'PRO_FORBIDDEN') AS limit_found, bool_or(rule_type = 'PER_AUTH') AS permit_found,
    count(*) FILTER (actor <> '' AND contains(who || chr(10) || what || chr(10) || how, actor)) AS holder_hits,
    count(*) FILTER (how LIKE '%支取现金%' OR rule_type = 'PRO_FORBIDDEN') AS cash_hits, count(*) FILTER (rule_type = 'DEF_SCOPE') AS definitions
    FROM ev JOIN asked USING (query_id) GROUP BY 1) e USING (query_id) WHERE profile_id IS NOT NULL),
parts AS (
  SELECT query_id, profile_id, 'duty_rule' AS rule_id, 70 AS priority, true AS needed, duty_found OR permit_found AS met, false AS exc, false AS forb FROM f WHERE profile_id = 'opening'
  UNION ALL SELECT query_id, profile_id, 'material_rule', 80, asks_material, material_found, false, false FROM f WHERE profile_id = 'opening'
  UNION ALL SELECT query_id, profile_id, 'holder_rule', 80, holder_asked, holder_found, false, false FROM f WHERE profile_id = 'opening'
  UNION ALL SELECT query_id, profile_id, 'boundary_rule', 100, asks_material OR NOT holder_asked, true, permit_found AND NOT asks_open_material, limit_found AND NOT duty_found FROM f WHERE profile_id = 'opening'
  UNION ALL SELECT query_id, profile_id, 'actor_scope', 0, actor <> '', holder_hits > 0, false, false FROM f WHERE profile_id = 'cash'
  UNION ALL SELECT query_id, profile_id, 'cash_use', 0, question LIKE '%现金%', cash_hits >= 2, false, false FROM f WHERE profile_id = 'cash'
  UNION ALL SELECT query_id, profile_id, 'definition', 0, true, definitions >= 1, false, false FROM f WHERE profile_id = 'cash'),
states AS (SELECT *, CASE WHEN profile_id = 'cash' THEN needed AND NOT met ELSE needed AND NOT exc AND (NOT met OR forb) END AS failed FROM parts)
"""


@query
def scene_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = P.catalog(spark, PROFILES)
    out = P.states(asked_questions(spark, sf_dir), customer_evidence(spark, sf_dir), known)
    return out.select("query_id", "profile_id", "rule_id", "priority", "needed", "covered", "failed", "requirement_met", "exception_hit", "forbid_hit")


ORACLE["scene_rules"] = _PROFILED + """SELECT query_id, profile_id, rule_id, priority, needed, CASE WHEN profile_id = 'cash' THEN met ELSE needed AND NOT failed END AS covered,
  failed, met AS requirement_met, exc AS exception_hit, forb AS forbid_hit FROM states"""


@query
def scene_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's profile misses, by priority, and where recall should go on."""
    known = P.catalog(spark, PROFILES)
    out = P.profile_facts(asked_questions(spark, sf_dir), customer_evidence(spark, sf_dir), known)
    return out.select(
        "query_id", "scene_profile_id", "scene_requirement_needed_count", "scene_requirement_covered_count", "scene_requirement_missing_count", "min_evidence_count", "min_direct_basis_count",
        F.array_join(F.transform("scene_missing_dimensions", lambda gap: F.concat_ws(":", gap["dimension"], gap["reason"])), "|").alias("missing"),
        F.array_join(F.transform("scene_directions", lambda way: F.concat(way["direction"], way["missing_dimension"])), "|").alias("directions"))


def _said(rows: list[tuple[str, str, str]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + value + "'" for value in row) + ")" for row in rows) + ")"


_GAPS = [("duty_rule", "义务依据:duty_rule 未满足", ""), ("material_rule", "材料要求:证据未覆盖材料清单。", "D材料要求|A材料要求"), ("holder_rule", "主体范围:证据未命中该主体。", "A主体范围"),
         ("boundary_rule", "例外/禁止边界:限制性规则缺少例外边界。", "E例外/禁止边界|F例外/禁止边界"), ("actor_scope", "主体范围:缺少主体规则。", "A主体范围"),
         ("cash_use", "现金支取:缺少现金规则。", "D现金支取"), ("definition", "定义范围:缺少定义。", "D定义范围|A定义范围")]
_ORDER = "-priority, CASE rule_id WHEN 'actor_scope' THEN '0' WHEN 'cash_use' THEN '1' WHEN 'definition' THEN '2' ELSE rule_id END"
ORACLE["scene_gaps"] = _PROFILED + f""", said(rule_id, gap, ways) AS {_said(_GAPS)}
SELECT query_id, profile_id AS scene_profile_id, count(*) FILTER (needed) AS scene_requirement_needed_count, count(*) FILTER (needed AND NOT failed) AS scene_requirement_covered_count,
  count(*) FILTER (failed) AS scene_requirement_missing_count, CASE profile_id WHEN 'opening' THEN 5 ELSE 6 END AS min_evidence_count, CASE profile_id WHEN 'cash' THEN 2 ELSE 3 END AS min_direct_basis_count,
  coalesce(string_agg(gap, '|' ORDER BY {_ORDER}) FILTER (failed), '') AS missing, coalesce(string_agg(ways, '|' ORDER BY {_ORDER}) FILTER (failed AND ways <> ''), '') AS directions
FROM states JOIN said USING (rule_id) GROUP BY query_id, profile_id"""


# Judgement rules of two profiles, placed before the general table.
SCENE_JUDGEMENTS = {
    "opening": [D._rule("opening_forbidden", "不可办理", "generated", 0.7, "限制性规则成立。", "复核限制。", [D._over("prohibition_count", 1), D._is("exception_count", 0)])],
    "cash": [D._rule("cash_conditional", "有条件可办理", "generated", 0.5, "满足条件后办理。", "核验条件。", [D.READY], [D._over("conditional_signal_count", 2), D._over("ambiguity_count", 3)])],
}


@query
def scene_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = derive(spark, sf_dir, FACTS).withColumn("has_conflicting_rules", (F.col("prohibition_count") > 0) & (F.col("exception_count") > 0))
    found = P.detect(asked_questions(spark, sf_dir), P.catalog(spark, PROFILES)).select(F.col("query_id").cast("long").alias("query_id"), F.col("profile_id").alias("scene_profile_id"))
    out = D.final_judgement(facts.join(found, "query_id", "left").fillna("", ["scene_profile_id"]), scene_rules=SCENE_JUDGEMENTS)
    return out.select("query_id", F.array_join("matched_rules", ">").alias("matched_rules"), "conclusion", "confidence")


def _judgements() -> str:
    from rulegrain.plans.table_queries import _TESTS

    tests = {"opening_forbidden": "profile_id = 'opening' AND prohibition_count > 1 AND exception_count = 0",
             "cash_conditional": "profile_id = 'cash' AND can_make_final AND (conditional_signal_count > 2 OR ambiguity_count > 3)", **_TESTS}
    rules = {rule["rule_id"]: rule for listed in (*SCENE_JUDGEMENTS.values(), D.FINAL_RULES) for rule in listed}
    case = lambda field: "CASE rule_id " + " ".join(f"WHEN '{name}' THEN {field(rules[name])}" for name in tests) + " END"
    hits = " ".join(f"WHEN {test} THEN '{name}'" for name, test in tests.items())
    return _PROFILED + f""", facts AS ({ansi(FACTS)}), hit AS (SELECT facts.query_id, coalesce(profile_id, '') AS profile_id, CASE {hits} END AS rule_id
  FROM facts LEFT JOIN prof ON prof.query_id = CAST(facts.query_id AS STRING))
SELECT query_id, CASE WHEN profile_id <> '' THEN profile_id || '>' ELSE '' END || rule_id AS matched_rules, {case(lambda r: "'" + r["conclusion"] + "'")} AS conclusion,
  CAST({case(lambda r: str(r["confidence"]))} AS DOUBLE) AS confidence FROM hit"""


ORACLE["scene_judgements"] = _judgements()

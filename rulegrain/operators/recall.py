"""Evidence recall for tables of questions: batch reports and the multi-round loop.

Joins carry no broadcast hints: the question side is measured by adaptive execution, which
broadcasts it when it turns out small and keeps the shuffled join when not.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.rules import decision, fact_types, first_match, render
from rulegrain.functions.text import cited_titles, clean_text, has_any, is_true, split_focus_terms, strip, text, truncate, words
from rulegrain.operators import profiles as P
from rulegrain.operators.containment import find_terms, with_term_lists
from rulegrain.operators.scale import broadcast_if_small, ordered_distinct, top_rows
from rulegrain.session import cut_lineage

SCORE_FIELDS = [("what", 8), ("how", 7), ("where", 6), ("content_original", 5), ("source_document", 3)]
BREAK = chr(1)  # in no term
PER_DOCUMENT = 8


# ------------------------------------------------------------------ batch report
def recall_hits(queries: DataFrame, atoms: DataFrame, scenes: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Scenes, broad hits and precise hits of each query (F1, F2).

    ``queries`` has query_id, query, who_terms. Equal query texts are searched once.
    """
    wanted = queries.select("query_id", "query").filter(F.col("query") != "")
    names = scenes.select("scene_key", "scene_name", "module_code", F.col("scene_name").alias("_name"))
    seen = find_terms(names, "_name", wanted, "query").withColumnRenamed("term", "query")
    scene_hits = seen.join(wanted, "query").drop("query")
    listed = lambda name: F.concat(F.lit('["'), F.array_join(name, '", "'), F.lit('"]'))
    blob = F.concat_ws(" ", text("content_original"), text("what"), text("how"), text("where"), listed("modules"), listed("categories"))
    rows = atoms.select("atom_id", "row_no", blob.alias("_blob"))
    by_text = find_terms(rows, "_blob", wanted, "query").join(wanted.withColumnRenamed("query", "term"), "term").select("query_id", "atom_id", "row_no")
    codes = scene_hits.select("query_id", F.col("module_code").alias("code")).distinct()
    by_module = atoms.select("atom_id", "row_no", F.explode("label_codes").alias("code")).join(codes, "code").select("query_id", "atom_id", "row_no")
    precise = matches.join(scene_hits.select("query_id", "scene_key"), "scene_key").select("query_id", "atom_id").distinct()
    return {"scenes": scene_hits, "broad": by_text.union(by_module).distinct(), "precise": precise}


def recall_report(queries: DataFrame, atoms: DataFrame, modules: DataFrame, scenes: DataFrame, matches: DataFrame, module_hits: int | None = None) -> DataFrame:
    """Counts and top lists per query (F2, F3). ``atoms`` carries who_terms; top modules come from all hits or the first ``module_hits``."""
    hits = recall_hits(queries, atoms, scenes, matches)
    count = lambda rows, alias: rows.groupBy("query_id").agg(F.count("*").alias(alias))
    first = top_rows(hits["broad"], ["query_id"], [F.col("row_no"), F.col("atom_id")], 10).select("query_id", "atom_id", "rank")
    info = modules.select("code", "label_path", F.concat_ws(" > ", "section", "category").alias("category_path")).dropDuplicates(["code"])
    order = [F.col("row_no"), F.col("atom_id")]
    tallied = hits["broad"] if module_hits is None else top_rows(hits["broad"], ["query_id"], order, module_hits)
    tagged = tallied.select("query_id", "atom_id").join(atoms.select("atom_id", F.explode("label_codes").alias("code")), "atom_id").join(info, "code")

    def top(rows: DataFrame, name: str, alias: str) -> DataFrame:
        counted = rows.groupBy("query_id", name).agg(F.count("*").alias("n"))
        best = top_rows(counted, ["query_id"], [F.desc("n"), F.col(name)], 10)
        return best.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", name, "n"))),
                                                        lambda item: F.struct(item[name].alias("name"), item["n"].alias("n"))).alias(alias))

    named = hits["precise"].join(atoms.select("atom_id", "who", "who_terms"), "atom_id").join(
        queries.select("query_id", F.col("who_terms").alias("wanted")), "query_id")
    body = clean_text("who")
    refined = named.filter(F.exists("wanted", lambda term: F.contains(body, term) | F.array_contains("who_terms", term)))
    words_of = lambda rows: rows.select("query_id", F.explode("who_terms").alias("term"))
    parts = [
        count(hits["scenes"], "matched_scene_count"), count(hits["broad"], "broad_recall_count"), count(hits["precise"], "precise_recall_count"),
        count(refined, "who_refined_count"), top(tagged, "label_path", "top_modules"), top(tagged, "category_path", "top_categories"),
        top(words_of(named), "term", "top_precise_who_terms"), top(words_of(refined), "term", "top_refined_who_terms"),
        first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "atom_id"))), lambda item: item["atom_id"]).alias("sample_atoms")),
    ]
    out = reduce(lambda a, b: a.join(b, "query_id", "left"), parts, queries)
    counts = ["matched_scene_count", "broad_recall_count", "precise_recall_count", "who_refined_count"]
    return out.fillna(0, counts).withColumn("who_refined_count", F.when(F.size("who_terms") > 0, F.col("who_refined_count")))


# ------------------------------------------------------------------ scoring primitives
def _points(term: Column) -> Column:
    """Points of the first field that holds a term."""
    weight = F.lit(0)
    for name, points in reversed(SCORE_FIELDS):
        weight = F.when(F.contains(name, term), points).otherwise(weight)
    return weight


def text_scores(terms: DataFrame, atoms: DataFrame, limit: int) -> DataFrame:
    """Score of each (query_id, atom_id) by the first field that holds each term.

    ``terms`` has query_id, term, at. Every distinct term is searched once over the atoms, however
    many questions ask for it. Returns score and the first ``limit`` matched terms.
    """
    asked = terms.filter(F.col("term") != "").groupBy("query_id", "term").agg(F.min("at").alias("at"))
    fields = [name for name, _ in SCORE_FIELDS]
    rows = atoms.select("atom_id", *fields, F.concat_ws(BREAK, *fields).alias("_all"))
    found = find_terms(rows, "_all", asked, "term", keep=["atom_id", *fields])
    hits = found.select("atom_id", "term", _points(F.col("term")).alias("points")).join(asked, "term")
    gathered = hits.groupBy("query_id", "atom_id").agg(F.sum("points").alias("score"), F.sort_array(F.collect_list(F.struct("at", "term"))).alias("t"))
    return gathered.select("query_id", "atom_id", "score", F.array_join(F.transform(F.slice("t", 1, limit), lambda item: item["term"]), "/").alias("matched"))


def accumulate(contributions: DataFrame) -> DataFrame:
    """Contributions (query_id, atom_id, score, reason) to candidates with ordered distinct reasons."""
    merged = contributions.groupBy("query_id", "atom_id", "reason").agg(F.sum("score").alias("score"), F.min("ord").alias("ord"))
    return merged.groupBy("query_id", "atom_id").agg(
        F.sum("score").cast("double").alias("score"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "reason"))), lambda item: item["reason"]).alias("reasons"))


def _gives(rows: DataFrame, score: Column, reason: Column, order: int) -> DataFrame:
    return rows.select("query_id", "atom_id", score.cast("double").alias("score"), reason.alias("reason"), F.lit(order).alias("ord"))


def rank_candidates(candidates: DataFrame, atoms: DataFrame, limit: Column | int, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Best candidates per question, at most 8 per document.

    The greedy pass equals a rank inside (question, document) followed by a rank per question; both
    prune inside the map tasks.
    """
    placed = candidates.join(atoms.select("atom_id", "source_document"), "atom_id")
    order = [F.desc("score"), F.col("atom_id")]
    diverse = top_rows(placed, ["query_id", "source_document"], order, per_document, "_doc_rank")
    if isinstance(limit, int):
        return top_rows(diverse, ["query_id"], order, limit).drop("_doc_rank")
    ranked = diverse.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit).drop("_doc_rank")


def focus_terms(routed: DataFrame, current: DataFrame | None = None, analysis: DataFrame | None = None, limit: int | None = 24, leaders: int | None = 8) -> DataFrame:
    """(query_id, focus array): question, route, leading atoms and gaps, first occurrence kept (I1); None lifts a limit."""
    parts = F.concat(split_focus_terms("question"), split_focus_terms("query"), "who_terms", "scene_names", "module_names")
    base = routed.select("query_id", parts.alias("focus"))
    if current is not None:
        leading = (current if leaders is None else current.filter(F.col("rank") <= leaders)).groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct("rank", F.concat(split_focus_terms("what"), split_focus_terms("where")).alias("terms")))).alias("l"))
        leading = leading.select("query_id", F.flatten(F.transform("l", lambda item: item["terms"])).alias("leading"))
        base = base.join(leading, "query_id", "left").withColumn("focus", F.concat("focus", F.coalesce("leading", words([])))).drop("leading")
    if analysis is not None:
        missing = F.flatten(F.transform("missing_elements", lambda item: split_focus_terms(item)))
        gaps = analysis.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
            "position", F.concat(split_focus_terms("next_split_focus"), missing).alias("terms")))).alias("g"))
        gaps = gaps.select("query_id", F.flatten(F.transform("g", lambda item: item["terms"])).alias("gaps"))
        base = base.join(gaps, "query_id", "left").withColumn("focus", F.concat("focus", F.coalesce("gaps", words([])))).drop("gaps")
    kept = F.filter(F.array_distinct("focus"), lambda term: (term != "") & ~term.isin(V.GENERIC_FOCUS_TERMS))
    return base.select("query_id", (kept if limit is None else F.slice(kept, 1, limit)).alias("focus"))


def _term_rows(rows: DataFrame, column: str = "focus") -> DataFrame:
    return rows.select("query_id", F.posexplode(column).alias("at", "term"))


def _scene_reason(lead: str, with_score: bool) -> Column:
    parts = [F.lit(f"{lead}:"), F.col("scene_name")] + ([F.lit(":"), F.col("match_score").cast("string")] if with_score else [])
    return F.concat(*parts)


def _scene_rows(routed: DataFrame, matches: DataFrame, scenes: DataFrame) -> DataFrame:
    wanted = routed.select("query_id", F.explode("scene_keys").alias("scene_key"))
    names = scenes.select("scene_key", "scene_name")
    return matches.select("atom_id", "scene_key", F.col("score").alias("match_score")).join(wanted, "scene_key").join(names, "scene_key")


def initial_candidates(routed: DataFrame, atoms: DataFrame, modules: DataFrame, scenes: DataFrame, matches: DataFrame, focus_limit: int | None = 24) -> DataFrame:
    """Candidates by scene (45 + score), module (14), text (10 or more) and actor (18) (I4)."""
    by_scene = _gives(_scene_rows(routed, matches, scenes), F.col("match_score") + 45, _scene_reason("场景精召回", True), 1)
    codes = routed.select("query_id", F.explode("module_codes").alias("code"))
    labels = modules.select("code", "label_path").dropDuplicates(["code"])
    tagged = atoms.select("atom_id", F.explode("label_codes").alias("code")).join(codes, "code").join(labels, "code")
    by_module = _gives(tagged, F.lit(14), F.concat(F.lit("业务模块宽召回:"), "label_path"), 2)
    hits = text_scores(_term_rows(focus_terms(routed, limit=focus_limit)), atoms, 5).filter(F.col("score") >= 10)
    by_text = _gives(hits, F.col("score"), F.concat(F.lit("语义命中:"), "matched"), 3)
    actors = routed.select("query_id", F.posexplode("who_terms").alias("at", "term"))
    found = find_terms(atoms.select("atom_id", clean_text("who").alias("_who")), "_who", actors, "term").join(actors, "term")
    named = ordered_distinct(found, ["query_id", "atom_id"], "term", "at", None, "terms")
    by_actor = _gives(named, F.lit(18), F.concat(F.lit("主体细筛:"), F.array_join("terms", "/")), 4)
    return accumulate(reduce(DataFrame.unionByName, [by_scene, by_module, by_text, by_actor]))


def evidence_rows(current: DataFrame, limit: int | None) -> DataFrame:
    """Current atoms with whole fields, as the judgement reads them (I6); only briefs are truncated."""
    rows = current if limit is None else current.filter(F.col("rank") <= limit)
    return rows.withColumn("is_ambiguous", is_true("is_ambiguous")).withColumn("score", F.round("score", 2))


def round_context(current: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """Leading documents and modules of each question."""
    docs = current.groupBy("query_id", "source_document").agg(F.count("*").alias("n"))
    paths = modules.select("code", "label_path").dropDuplicates(["code"])
    tagged = current.select("query_id", F.explode("label_codes").alias("code")).join(paths, "code").groupBy("query_id", "label_path").agg(F.count("*").alias("n"))
    return {
        "documents": top_rows(docs, ["query_id"], [F.desc("n"), F.col("source_document")], 8),
        "modules": top_rows(tagged, ["query_id"], [F.desc("n"), F.col("label_path")], 8),
    }


# ------------------------------------------------------------------ judgement
def _eq(fact: str, value: Any) -> dict:
    return {"fact": fact, "eq": value}


_PROFILE, _BASIS, _CONFLICT = _eq("has_scene_profile", True), _eq("basis_ready", True), _eq("has_conflicting_rules", True)
_NONE_MISSING = _eq("scene_requirement_missing_count", 0)
GO_ON, STOP = "继续召回", "停止召回"

# The ordered recall decision table; the last row is the default.
RECALL_RULES: list[Mapping[str, Any]] = [
    {"rule_id": name, "when": when, "decision": what, "can_make_final": final, "confidence": sure, "summary": said}
    for name, when, what, final, sure, said in [
        ("scene_profile_missing_requirement", {"all": [_PROFILE, {"fact": "scene_requirement_missing_count", "gt": 0}]}, GO_ON, False, 0.34,
         "当前场景规则仍有关键 requirement 未满足，应继续按场景规则补召回。"),
        ("scene_profile_ready_with_conflict", {"all": [_PROFILE, _NONE_MISSING, _BASIS, _CONFLICT]}, STOP, True, 0.52,
         "当前场景 requirement 已满足，但限制与例外规则并存，更适合停止召回并进入最终审查。"),
        ("scene_profile_ready", {"all": [_PROFILE, _NONE_MISSING, _BASIS]}, STOP, True, 0.63, "当前场景 requirement 已满足，证据可进入最终合规结论生成。"),
        ("route_or_scope_gap", {"any": [_eq("gap_business_route", True), _eq("gap_scope", True)]}, GO_ON, False, 0.22,
         "当前业务路由或主体范围仍未收敛，需优先补齐语境定位后再判断是否闭环。"),
        ("semantic_gap_needs_more_evidence", {"any": [_eq(f"gap_{gap}", True) for gap in ("material", "process", "threshold", "definition", "exception_boundary")]},
         GO_ON, False, 0.3, "当前仍存在关键语义缺口，继续补召回比直接下结论更合理。"),
        ("direct_basis_gap", {"any": [{"all": [_eq("gap_direct_basis", True), {"not": _BASIS}]},
                                      {"all": [{"fact": "evidence_count", "lt": 6}, {"fact": "direct_basis_count", "lt": 3}]}]},
         GO_ON, False, 0.26, "当前直接法条依据仍偏薄，继续补证据更稳妥。"),
        ("ready_with_conflict", {"all": [_eq("ready_without_missing", True), _CONFLICT]}, STOP, True, 0.54,
         "当前证据已基本闭环，但限制与例外规则并存，更适合停止补召回并进入最终审查或人工复核。"),
        ("ready_for_final", {"all": [_eq("ready_without_missing", True), {"not": _eq("gap_direct_basis", True)}]}, STOP, True, 0.62,
         "当前证据覆盖已满足最终判断的最低要求，可以停止召回并进入最终合规结论生成。"),
        ("fallback_continue", {"fact": "evidence_count", "gte": 0}, GO_ON, False, 0.2, "当前证据尚未达到稳定闭环状态，继续召回更安全。"),
    ]
]

# Gap fact, dimension, reason, recommended directions with their reasons.
GAPS = [
    ("gap_business_route", "业务场景定位", "当前证据仍不足以稳定定位到具体业务场景或模块，需先补齐场景路由证据。",
     [("A", "沿当前业务路径继续向下收敛场景。"), ("B", "补充同层相邻场景，确认是否路由偏移。")]),
    ("gap_scope", "主体范围", "问题存在明确主体约束，但当前证据未命中该主体的直接规则依据。",
     [("A", "优先沿当前场景继续下钻主体相关规则。"), ("D", "围绕主体适用对象补齐定义与条件。")]),
    ("gap_definition", "定义范围", "当前证据未覆盖关键术语或适用对象的定义边界，结论边界仍不稳定。",
     [("D", "优先补定义、适用范围和术语解释。"), ("F", "补充上位法或实施细则中的定义依据。")]),
    ("gap_material", "材料要求", "问题直接涉及提交材料或签章，但当前证据未覆盖明确材料清单。",
     [("D", "补齐材料、证件、签章类规则。"), ("A", "沿当前业务场景继续下钻办理材料。")]),
    ("gap_process", "流程动作", "问题直接涉及办理动作或审核步骤，但当前证据未覆盖关键执行动作。",
     [("D", "补齐流程、审核、核查动作类规则。"), ("C", "查找相邻条款中的流程细节。")]),
    ("gap_threshold", "时限阈值", "问题涉及金额、现金、期限等边界条件，但当前证据未覆盖明确阈值或时限。",
     [("D", "补齐金额、期限、现金字样等条件规则。"), ("C", "优先补相邻条款中的阈值边界。")]),
    ("gap_exception_boundary", "例外/禁止边界", "当前证据已命中限制性规则，但尚未覆盖例外、授权或边界条款。",
     [("E", "优先补例外、但书和禁止边界。"), ("F", "补充上位法、细则或配套规范。")]),
    ("gap_basis_thin", "规范依据", "当前直接法条依据仍偏薄，尚不足以稳定支撑最终判断。",
     [("C", "优先补相邻条款和同文档上下文。"), ("F", "补充上下位规范与实施细则。")]),
]


DIMENSIONS = "array<struct<dimension:string,reason:string>>"
DIRECTIONS = "array<struct<direction:string,reason:string,missing_dimension:string>>"


def _blob(*names: str) -> Column:
    return F.concat_ws("\n", *[text(name) for name in names])


EVIDENCE_BLOB = ("who", "what", "how", "where", "content_original", "source_document")


def recall_facts(routed: DataFrame, evidence: DataFrame, profile_facts: DataFrame | None = None, min_evidence: int = 6, min_basis: int = 3) -> DataFrame:
    """One row of facts per question: one aggregation over its evidence, then derived tests (I8).

    ``profile_facts`` are those of :func:`rulegrain.operators.profiles.profile_facts` for questions with a scene profile.
    """
    blob, rule = _blob(*EVIDENCE_BLOB), F.col("rule_type")
    actors = _blob("who", "what", "how")
    joined = evidence.join(routed.select("query_id", "who_terms"), "query_id")
    both = lambda types, terms: F.count_if(rule.isin(types)) + F.count_if(has_any(blob, terms))
    counted = joined.groupBy("query_id").agg(
        F.count("*").alias("evidence_count"),
        F.count_if((strip("article_reference") != "") & (strip("source_document") != "")).alias("direct_basis_count"),
        F.countDistinct(F.nullif(strip("source_document"), F.lit(""))).alias("distinct_doc_count"),
        F.count_if(F.exists("who_terms", lambda term: F.contains(actors, term))).alias("actor_hit_count"),
        F.count_if(has_any(blob, V.MATERIAL_TERMS)).alias("material_evidence_count"),
        both(["PRC_FLOW", "OBL_MANDATORY", "OBL_ONGOING"], V.PROCESS_TERMS).alias("process_rule_count"),
        both(["VAL_THRESHOLD"], V.THRESHOLD_TERMS).alias("threshold_rule_count"),
        both(["DEF_SCOPE"], V.DEFINITION_TERMS).alias("definition_rule_count"),
        both(["PRO_FORBIDDEN"], V.PROHIBITION_TERMS).alias("prohibition_rule_count"),
        both(["PER_AUTH"], V.EXCEPTION_TERMS).alias("exception_rule_count"),
        F.count_if("is_ambiguous").alias("ambiguity_count"),
    )
    out = routed.select("query_id", "question", "who_terms", "scene_keys", "module_codes").join(counted, "query_id", "left").fillna(0)
    if profile_facts is not None:
        out = out.join(profile_facts, "query_id", "left")
    else:
        for name, kind in (("scene_profile_id", "string"), ("scene_requirement_missing_count", "long"), ("min_evidence_count", "int"), ("min_direct_basis_count", "int"),
                           ("scene_missing_dimensions", DIMENSIONS), ("scene_directions", DIRECTIONS)):
            out = out.withColumn(name, F.lit(None).cast(kind))
    out = out.fillna({"scene_profile_id": "", "scene_requirement_missing_count": 0, "min_evidence_count": min_evidence, "min_direct_basis_count": min_basis})
    n, q = F.col, F.col("question")
    steps = [
        ("has_scene_profile", n("scene_profile_id") != ""),
        ("question_mentions_actor", F.size("who_terms") > 0), ("question_mentions_material", has_any(q, V.MATERIAL_TERMS)),
        ("question_mentions_process", has_any(q, [*V.PROCESS_TERMS, *V.HOW_QUESTION_TERMS])), ("question_mentions_threshold", has_any(q, V.THRESHOLD_TERMS)),
        ("question_mentions_definition", has_any(q, V.DEFINITION_TERMS)),
        ("matched_scene_count", F.size("scene_keys")), ("matched_module_count", F.size("module_codes")),
        ("route_ready", (n("matched_scene_count") > 0) | (n("matched_module_count") > 0)),
        ("basis_ready", (n("evidence_count") >= n("min_evidence_count")) & (n("direct_basis_count") >= n("min_direct_basis_count"))),
        ("has_conflicting_rules", (n("prohibition_rule_count") > 0) & (n("exception_rule_count") > 0)),
        ("gap_business_route", ~n("route_ready")), ("gap_scope", n("question_mentions_actor") & (n("actor_hit_count") == 0)),
        ("gap_material", n("question_mentions_material") & (n("material_evidence_count") == 0)),
        ("gap_process", n("question_mentions_process") & (n("process_rule_count") == 0)),
        ("gap_threshold", n("question_mentions_threshold") & (n("threshold_rule_count") == 0)),
        ("gap_definition", n("question_mentions_definition") & (n("definition_rule_count") == 0)),
        ("gap_exception_boundary", (n("prohibition_rule_count") > 0) & (n("exception_rule_count") == 0)),
        ("gap_direct_basis", n("direct_basis_count") < n("min_direct_basis_count")),
        ("structural_gap_count", reduce(lambda a, b: a + b, [n(gap).cast("int") for gap, *_ in GAPS[:-1]])),
        ("ready_without_missing", n("route_ready") & n("basis_ready") & (n("structural_gap_count") == 0) & (n("scene_requirement_missing_count") == 0)),
        ("gap_basis_thin", n("gap_direct_basis") & ~n("ready_without_missing")),
    ]
    for name, value in steps:
        out = out.withColumn(name, value)
    return out


def recall_judgement(facts: DataFrame, rules: list[Mapping[str, Any]] = RECALL_RULES, most_dimensions: int | None = 8, most_directions: int | None = 6) -> DataFrame:
    """Decision, missing dimensions (8) and directions (6) per question (I9, I10); None keeps all.

    What a question's scene profile lacks stands in place of the general gaps.
    """
    traced = [{**rule, "decision_trace": [render(rule["when"])]} for rule in rules]
    fields = ["rule_id", "decision", "can_make_final", "confidence", "summary", "decision_trace"]
    out = facts.withColumn("_d", decision(traced, fact_types(facts), fields)).select("*", "_d.*").drop("_d")
    dimension = lambda name, reason: F.struct(F.lit(name).alias("dimension"), F.lit(reason).alias("reason"))
    missing = F.array_compact(F.array(*[F.when(F.col(gap), dimension(name, reason)) for gap, name, reason, _ in GAPS]))
    direction = lambda code, reason, name: F.struct(F.lit(code).alias("direction"), F.lit(reason).alias("reason"), F.lit(name).alias("missing_dimension"))
    directions = F.array_compact(F.array(*[F.when(F.col(gap), direction(code, reason, name)) for gap, name, _, ways in GAPS for code, reason in ways]))
    done = (F.col("decision") == STOP) & F.col("can_make_final")
    by_scene = F.col("has_scene_profile") & (F.coalesce(F.size("scene_missing_dimensions"), F.lit(0)) > 0)
    shown = lambda own, general, most: F.slice(
        F.when(by_scene, F.coalesce(own, F.slice(general, 1, 0))).otherwise(general), 1, F.when(done, 0).otherwise(2**31 - 1 if most is None else most))
    return out.withColumn("missing_dimensions", shown(F.col("scene_missing_dimensions"), missing, most_dimensions)).withColumn(
        "directions", shown(F.col("scene_directions"), directions, most_directions))


def atoms_to_analyse(current: DataFrame, limit: int = 6) -> DataFrame:
    """Atoms most in need of a closer look; equal scores take the larger id first."""
    bonus = (
        F.when(is_true("is_ambiguous"), 10).otherwise(0) + F.when(~strip("review_reason").isin("", "NONE"), 5).otherwise(0)
        + F.when(F.col("rule_type").isin("DEF_SCOPE", "VAL_THRESHOLD", "PRC_FLOW"), 6).otherwise(0)
    )
    scored = current.drop("rank").withColumn("check_score", F.col("score") + bonus)
    return top_rows(scored, ["query_id"], [F.desc("check_score"), F.desc("atom_id")], limit, "position")


def atom_analysis(picked: DataFrame, routed: DataFrame, scene_gaps: DataFrame | None = None) -> DataFrame:
    """What each picked atom lacks for direct execution.

    ``scene_gaps`` (query_id, atom_id, scene_labels) says what an atom lacks by the scene profile of its question, in place of the
    tests on the wording of the question.
    """
    rows = evidence_rows(picked.withColumn("rank", F.col("position")), None).join(
        routed.select("query_id", "question", "who_terms"), "query_id")
    blob, q = _blob(*EVIDENCE_BLOB), F.col("question")
    asks = lambda terms: has_any(q, terms) & ~has_any(blob, terms)
    process = has_any(q, [*V.PROCESS_TERMS, *V.HOW_QUESTION_TERMS]) & ~has_any(blob, V.PROCESS_TERMS)
    by_wording = F.array_compact(F.array(
        F.when((F.size("who_terms") > 0) & ~F.exists("who_terms", lambda term: F.contains(blob, term)), "主体范围"),
        F.when(asks(V.MATERIAL_TERMS), "材料或签章要求"), F.when(process, "流程动作"), F.when(asks(V.THRESHOLD_TERMS), "时限或阈值条件"),
        F.when(asks(V.DEFINITION_TERMS), "定义范围")))
    always = F.array_compact(F.array(F.when(strip("article_reference") == "", "法条依据定位"), F.when(F.col("is_ambiguous"), "歧义条款需复核")))
    if scene_gaps is not None:
        rows = rows.join(scene_gaps, ["query_id", "atom_id"], "left")
        by_wording = F.coalesce("scene_labels", by_wording)
    out = rows.withColumn("missing_elements", F.slice(F.array_distinct(F.concat(by_wording, always)), 1, 5))
    some = F.size("missing_elements") > 0
    reason = F.concat(F.lit("当前原子仍缺少"), F.array_join(F.slice("missing_elements", 1, 3), "、"), F.lit("，建议继续细化。"))
    return out.select(
        "query_id", "atom_id", "position", F.when(some, "继续拆解").otherwise("停止拆解").alias("decision"),
        F.when(some, reason).otherwise("当前原子已具备直接执行所需的关键信息。").alias("reason"), "missing_elements",
        F.coalesce(F.get("missing_elements", F.lit(0)), F.lit("")).alias("next_split_focus"))


def gap_profiles(judged: DataFrame, analysis: DataFrame) -> DataFrame:
    """Semantic buckets that the missing texts point to; process and definition when none does (I16)."""
    said = analysis.groupBy("query_id").agg(F.array_join(F.flatten(F.collect_list("missing_elements")), "\n").alias("lacking"))
    dims = F.array_join(F.transform("missing_dimensions", lambda item: F.concat_ws("\n", item["dimension"], item["reason"])), "\n")
    joined = judged.join(said, "query_id", "left").withColumn("signals", F.concat_ws("\n", dims, F.coalesce("lacking", F.lit(""))))
    found = F.array_compact(F.array(*[F.when(has_any("signals", keywords), name) for name, (keywords, _, _) in V.SEMANTIC_BUCKETS.items()]))
    return joined.select("query_id", F.when(F.size(found) > 0, found).otherwise(words(["process", "definition"])).alias("profiles"))


# ------------------------------------------------------------------ expansions
def expand(
    active: DataFrame, current: DataFrame, atoms: DataFrame, modules: DataFrame, scenes: DataFrame, matches: DataFrame,
    segments: DataFrame, focus: DataFrame, profiles: DataFrame,
) -> DataFrame:
    """Contributions (query_id, atom_id, score, reason, ord, direction) of the recommended directions.

    ``active`` has the route of each open question and its ``wanted`` direction codes. Each direction
    only sees the questions that ask for it.
    """
    ask = lambda code: active.filter(F.array_contains("wanted", code))
    only = lambda rows, code: rows.join(ask(code).select("query_id"), "query_id", "left_semi")
    label = lambda rows, code: rows.withColumn("direction", F.lit(code))
    catalog = modules.select("code", "label_path", F.concat_ws("::", "section", "category").alias("category_key")).dropDuplicates(["code"])
    tags = atoms.select("atom_id", F.explode("label_codes").alias("code"))
    docs = current.select("query_id", "source_document").distinct()
    codes_now = current.select("query_id", F.explode("label_codes").alias("code")).distinct()

    # A: down the current scenes and modules
    a_scene = _gives(_scene_rows(ask("A"), matches, scenes), F.col("match_score") + 26, _scene_reason("A-业务向下", False), 1)
    scene_words = scenes.groupBy(F.col("module_code").alias("code")).agg(F.sort_array(F.collect_list(F.struct("scene_key", F.concat(F.array("scene_name"), "scene_terms").alias("terms")))).alias("s"))
    scene_words = scene_words.select("code", F.filter(F.array_distinct(F.flatten(F.transform("s", lambda item: item["terms"]))), lambda term: ~term.isin(V.GENERIC_FOCUS_TERMS)).alias("terms"))
    pairs = ask("A").select("query_id", F.explode("module_codes").alias("code")).join(scene_words, "code", "left").join(focus, "query_id")
    pairs = pairs.withColumn("pair_id", F.concat_ws(BREAK, "query_id", "code")).withColumn(
        "extra", F.array_distinct(F.concat(F.slice(F.coalesce("terms", words([])), 1, 10), F.slice("focus", 1, 10))))
    pair_terms = pairs.select(F.col("pair_id").alias("query_id"), F.posexplode("extra").alias("at", "term"))
    a_hits = text_scores(pair_terms, atoms, 4).withColumn("code", F.substring_index("query_id", BREAK, -1)).withColumn("query_id", F.substring_index("query_id", BREAK, 1))
    a_hits = a_hits.filter(F.col("score") >= 12).join(tags, ["atom_id", "code"], "left_semi").join(catalog, "code")
    a_text = _gives(a_hits, F.col("score") + 10, F.concat(F.lit("A-业务向下:"), "label_path", F.lit(":"), "matched"), 2)

    # B: sibling scenes of the category
    asked_b = ask("B").select("query_id", "question", F.explode("module_codes").alias("code")).join(catalog.select("code", "category_key"), "code")
    siblings = asked_b.join(catalog.select(F.col("code").alias("module_code"), "category_key"), "category_key").select("query_id", "question", "module_code")
    own = asked_b.select("query_id", "question", F.col("code").alias("module_code"))
    visits = siblings.unionAll(own).groupBy("query_id", "question", "module_code").agg(F.count("*").alias("visits"))
    near = visits.join(scenes.select("scene_key", "scene_name", "scene_terms", "module_code"), "module_code").join(focus, "query_id")
    near = near.join(ask("B").select("query_id", F.explode("scene_keys").alias("scene_key")), ["query_id", "scene_key"], "left_anti")
    points = F.when(F.exists("scene_terms", lambda term: F.contains("question", term)), 12).otherwise(0) + F.when(F.exists("focus", lambda term: F.contains("scene_name", term)), 10).otherwise(0)
    near = near.withColumn("points", F.when(points == 0, 6).otherwise(points)).select("query_id", "scene_key", "scene_name", "points", "visits")
    b_rows = matches.select("atom_id", "scene_key", F.col("score").alias("match_score")).join(near, "scene_key")
    b_all = _gives(b_rows, (F.col("points") + F.col("match_score") * 0.5) * F.col("visits"), F.concat(F.lit("B-同层横向:"), "scene_name"), 3)

    # C: neighbouring articles
    c_all = _gives(adjacent_atoms(only(current, "C").filter(F.col("rank") <= 12), atoms, segments), F.lit(18) * F.col("times"),
                   F.concat(F.lit("C-法规邻接:"), "source_document", F.lit(":"), "neighbor_ref"), 4)

    # D: semantic completion per bucket
    d_parts = []
    for at, (name, (_, bucket_terms, bucket_types)) in enumerate(V.SEMANTIC_BUCKETS.items()):
        asked = ask("D").select("query_id").join(profiles.filter(F.array_contains("profiles", name)), "query_id", "left_semi").join(focus, "query_id")
        terms = asked.select("query_id", F.posexplode(F.array_distinct(F.concat(words(bucket_terms), "focus"))).alias("at", "term"))
        d_parts.append((name, at, asked.select("query_id"), terms, bucket_types))
    d_terms = reduce(DataFrame.unionByName, [terms.withColumn("query_id", F.concat_ws(BREAK, "query_id", F.lit(name))) for name, _, _, terms, _ in d_parts])
    d_hits = text_scores(d_terms, atoms, 4).withColumn("bucket", F.substring_index("query_id", BREAK, -1)).withColumn("query_id", F.substring_index("query_id", BREAK, 1))
    d_asked = reduce(DataFrame.unionByName, [asked.withColumn("bucket", F.lit(name)) for name, _, asked, _, _ in d_parts])
    types = F.create_map(*[part for name, (_, _, kinds) in V.SEMANTIC_BUCKETS.items() for part in (F.lit(name), words(kinds))])
    d_all = _bonus_rows(d_hits, d_asked, atoms, docs, codes_now, types, 12, 8, 6, 16)
    order = F.create_map(*[part for at, name in enumerate(V.SEMANTIC_BUCKETS) for part in (F.lit(name), F.lit(5 + at))])
    d_all = d_all.select("query_id", "atom_id", F.col("total").cast("double").alias("score"), F.concat(F.lit("D-语义补全:"), "bucket", F.lit(":"), "matched").alias("reason"), F.element_at(order, F.col("bucket")).alias("ord"))

    # E: exceptions and prohibitions first
    e_asked = ask("E").select("query_id").join(focus, "query_id")
    e_terms = e_asked.select("query_id", F.posexplode(F.array_distinct(F.concat("focus", words(V.EXCEPTION_FOCUS_TERMS)))).alias("at", "term"))
    e_types = F.create_map(F.lit("exception"), words(["PRO_FORBIDDEN", "PER_AUTH"]))
    e_all = _bonus_rows(text_scores(e_terms, atoms, 4).withColumn("bucket", F.lit("exception")), e_asked.select("query_id", F.lit("exception").alias("bucket")),
                        atoms, docs, codes_now.limit(0), e_types, 14, 6, 0, 18)
    e_all = _gives(e_all, F.col("total"), F.concat(F.lit("E-例外禁止:"), "matched"), 20)

    # F: other documents that are cited or named alike
    f_all = _gives(cited_documents(only(current, "F"), ask("F"), atoms), F.col("points"), F.concat(F.lit("F-上下位规范:"), F.when(F.col("matched") != "", F.col("matched")).otherwise(F.col("source_document"))), 21)
    return reduce(DataFrame.unionByName, [label(a_scene.unionByName(a_text), "A"), label(b_all, "B"), label(c_all, "C"), label(d_all, "D"), label(e_all, "E"), label(f_all, "F")])


def _bonus_rows(hits: DataFrame, asked: DataFrame, atoms: DataFrame, docs: DataFrame, codes: DataFrame, types: Column,
                type_points: int, doc_points: int, code_points: int, minimum: int) -> DataFrame:
    """Text points plus bonuses for rule type, current document and current module, kept from ``minimum`` on.

    Bonuses alone can reach the minimum, so the atoms of the current documents with a fitting rule
    type join the text hits; no other atom can pass.
    """
    in_docs = atoms.select("atom_id", "source_document", "rule_type").join(docs, "source_document").join(asked, "query_id")
    in_docs = in_docs.filter(F.array_contains(F.element_at(types, F.col("bucket")), F.col("rule_type"))).select("query_id", "bucket", "atom_id")
    in_codes = atoms.select("atom_id", "rule_type", F.explode("label_codes").alias("code")).join(codes, "code").join(asked, "query_id")
    in_codes = in_codes.filter(F.array_contains(F.element_at(types, F.col("bucket")), F.col("rule_type"))).select("query_id", "bucket", "atom_id").distinct()
    base = hits.select("query_id", "bucket", "atom_id", "score", "matched")
    silent = lambda rows: rows.withColumn("score", F.lit(0).cast("long")).withColumn("matched", F.lit(""))
    rows = base.unionByName(silent(in_docs)).unionByName(silent(in_codes)).groupBy("query_id", "bucket", "atom_id").agg(F.max("score").alias("score"), F.max("matched").alias("matched"))
    same_doc = docs.withColumn("in_doc", F.lit(True))
    same_code = atoms.select("atom_id", F.explode("label_codes").alias("code")).join(codes, "code").select("query_id", "atom_id", F.lit(True).alias("in_code")).distinct()
    full = rows.join(atoms.select("atom_id", "source_document", "rule_type"), "atom_id").join(same_doc, ["query_id", "source_document"], "left").join(same_code, ["query_id", "atom_id"], "left")
    total = (
        F.col("score") + F.when(F.array_contains(F.element_at(types, F.col("bucket")), F.col("rule_type")), type_points).otherwise(0)
        + F.when(F.col("in_doc"), doc_points).otherwise(0) + F.when(F.col("in_code"), code_points).otherwise(0)
    )
    return full.withColumn("total", total).filter(F.col("total") >= minimum)


def adjacent_atoms(leading: DataFrame, atoms: DataFrame, segments: DataFrame) -> DataFrame:
    """Atoms of the articles just before and after those of the leading atoms.

    ``segments`` has doc, ref, seg_no (dense per document). The article of an atom is the longest
    reference its own reference starts with, contains, or is contained in.
    """
    refs = leading.select("query_id", "atom_id", "source_document", strip("article_reference").alias("article")).filter(F.col("article") != "")
    places = refs.select("source_document", "article").distinct()
    seg = segments.select(F.col("doc").alias("source_document"), "ref", "seg_no").filter(F.col("ref") != "")
    fits = seg.join(places, "source_document").filter(F.contains("article", F.col("ref")) | F.contains("ref", F.col("article")))
    at = fits.groupBy("source_document", "article").agg(F.min_by("seg_no", F.struct(-F.length("ref"), F.col("seg_no"))).alias("seg_no"))
    beside = at.select("source_document", "article", F.explode(F.array(F.col("seg_no") - 1, F.col("seg_no") + 1)).alias("seg_no"))
    neighbors = beside.join(seg.withColumnRenamed("ref", "neighbor_ref"), ["source_document", "seg_no"])
    wanted = refs.join(neighbors, ["source_document", "article"]).groupBy("query_id", "source_document", "neighbor_ref").agg(F.count("*").alias("times"))
    pool = atoms.select("atom_id", "source_document", strip("article_reference").alias("_ref"))
    return pool.join(wanted, "source_document").filter(F.contains("_ref", F.col("neighbor_ref"))).select("query_id", "atom_id", "source_document", "neighbor_ref", "times")


def cited_documents(current: DataFrame, asked: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms of documents outside the current ones that are cited (18) or share name terms (5 each), from 10.

    Scores belong to document names, a small distinct list, and only then reach the atoms.
    """
    docs = current.groupBy("query_id", "source_document").agg(F.min("rank").alias("rank"))
    title_rows = current.select("query_id", "rank", F.explode(F.array_distinct(F.concat(cited_titles("content_original"), cited_titles("how")))).alias("title")).unionByName(
        asked.select("query_id", F.lit(0).alias("rank"), F.explode(cited_titles("question")).alias("title")))
    titles = title_rows.groupBy("query_id", "title").agg(F.min("rank").alias("rank"))
    names = docs.select("query_id", F.struct(F.lit(0).alias("p"), "rank").alias("at"), F.col("source_document").alias("name")).unionByName(
        titles.select("query_id", F.struct(F.lit(1).alias("p"), "rank").alias("at"), F.col("title").alias("name")))
    terms = names.select("query_id", "at", F.posexplode(split_focus_terms("name")).alias("i", "term"))
    first = ordered_distinct(terms.select("query_id", "term", F.struct("at", "i").alias("place")), ["query_id"], "term", "place", 12, "terms")
    library = atoms.select("source_document").distinct()
    lib = library.withColumn("_name", F.col("source_document"))
    term_rows = first.select("query_id", F.posexplode("terms").alias("at", "term"))
    alike = find_terms(lib, "_name", term_rows, "term").join(term_rows, "term").groupBy("query_id", "source_document").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "term"))).alias("t"))
    from rulegrain.operators.taxonomy import overlapping_values

    near = overlapping_values(library.select(F.col("source_document").alias("value")), titles.select(F.col("title").alias("needle")).distinct())
    cited = near.join(titles.select("query_id", F.col("title").alias("needle")), "needle").select("query_id", F.col("value").alias("source_document"), F.lit(18).alias("cite")).distinct()
    scored = alike.join(cited, ["query_id", "source_document"], "full_outer")
    points = F.coalesce("cite", F.lit(0)) + F.coalesce("n", F.lit(0)) * 5
    matched = F.array_join(F.transform(F.slice(F.coalesce("t", F.filter(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("term"))), lambda _: F.lit(False))), 1, 4), lambda item: item["term"]), "/")
    scored = scored.select("query_id", "source_document", points.alias("points"), matched.alias("matched")).filter(F.col("points") >= 10)
    others = scored.join(docs, ["query_id", "source_document"], "left_anti")
    return atoms.select("atom_id", "source_document").join(others, "source_document")


def merge_expansions(candidates: DataFrame, contributions: DataFrame, compat: bool = True) -> DataFrame:
    """Old candidates plus the expansion results.

    With ``compat`` a direction's score counts once per reason of that direction, and the merged
    expansion score once per reason of the merged map, as the reference results have it.
    """
    per_reason = contributions.groupBy("query_id", "atom_id", "direction", "reason").agg(F.sum("score").alias("score"), F.min("ord").alias("ord"))
    per_direction = per_reason.groupBy("query_id", "atom_id", "direction").agg(
        F.sum("score").alias("score"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ord", "reason"))).alias("r"))
    share = F.col("score") * F.col("n") if compat else F.col("score")
    merged = per_direction.groupBy("query_id", "atom_id").agg(
        F.sum(share).alias("add"), F.sum("n").alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("direction", "r"))), lambda item: item["r"])).alias("r"))
    merged = merged.select("query_id", "atom_id", (F.col("add") * F.col("n") if compat else F.col("add")).alias("add"), F.transform("r", lambda item: item["reason"]).alias("new_reasons"))
    joined = candidates.join(merged, ["query_id", "atom_id"], "full_outer")
    return joined.select(
        "query_id", "atom_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("score"),
        F.array_distinct(F.concat(F.coalesce("reasons", words([])), F.coalesce("new_reasons", words([])))).alias("reasons"))


# ------------------------------------------------------------------ kinds of atoms
ATOM_FIELDS = ["atom_id", "source_document", "article_reference", "rule_type", "who", "what", "how", "where", "content_original", "is_ambiguous", "review_reason", "label_codes"]


def signed_atoms(atoms: DataFrame, matches: DataFrame) -> DataFrame:
    """The fields of each atom with a digest of its scenes, and whether its id repeats."""
    scene = F.struct("scene_key", "score")
    rows = matches.select("atom_id", scene.alias("scene"), F.lit(0).alias("n")).unionByName(
        atoms.select("atom_id", F.lit(None).cast(matches.select(scene.alias("s")).schema["s"].dataType).alias("scene"), F.lit(1).alias("n")))
    scenes = F.sha1(F.to_json(F.sort_array(F.collect_list("scene"))))
    per_atom = rows.groupBy("atom_id").agg(scenes.alias("scenes"), (F.sum("n") > 1).alias("repeated"))
    return atoms.select(*ATOM_FIELDS).join(per_atom, "atom_id")


def with_kinds(signed: DataFrame, terms: DataFrame, actors: DataFrame) -> DataFrame:
    """Atoms with their ``kind``: a digest of all that the steps of the loop read of an atom to score it.

    That is its document, article, rule type, labels and scenes, the points of each of the ``terms`` and the ``actors`` that it names.
    Atoms of a kind get equal scores for equal reasons. Rows that share an id are a kind of their own.
    """
    rows = signed.withColumn("_all", F.concat_ws(BREAK, *[name for name, _ in SCORE_FIELDS])).withColumn("_who", clean_text("who"))
    rows = with_term_lists(with_term_lists(rows, "_all", terms, "term", "_terms"), "_who", actors, "term", "_actors")
    shown = F.sort_array(F.transform("_terms", lambda term: F.struct(term.alias("t"), _points(term).alias("p"))))
    read = F.struct("source_document", "article_reference", "rule_type", "label_codes", "scenes", shown.alias("shown"), F.sort_array("_actors").alias("actors"))
    kind = F.sha2(F.when(F.col("repeated"), F.concat(F.lit("id:"), F.col("atom_id").cast("string"))).otherwise(F.to_json(read)), 256)
    return rows.withColumn("kind", kind).drop("_all", "_who", "_terms", "_actors")


def leading_members(signed: DataFrame, terms: DataFrame, actors: DataFrame) -> DataFrame:
    """The rows of the first atoms of each kind, with kind and place.

    Equal scores rank by id and a document keeps ``PER_DOCUMENT`` atoms, so no later atom of a kind can be ranked.
    """
    order = Window.partitionBy("kind").orderBy("atom_id")
    first = with_kinds(signed, terms, actors).select("kind", "atom_id").withColumn("place", F.dense_rank().over(order))
    first = cut_lineage(first.filter(F.col("place") <= PER_DOCUMENT).distinct())
    return cut_lineage(signed.join(broadcast_if_small(first), "atom_id"))


def _as_kinds(members: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One atom per kind in place of the atoms, and its matches; the kind is the id."""
    first = members.filter(F.col("place") == 1)
    ids = first.select("atom_id", "kind").distinct()
    own = matches.select("atom_id", "scene_key", "score").join(broadcast_if_small(ids), "atom_id")
    return first.drop("atom_id").withColumnRenamed("kind", "atom_id"), cut_lineage(own.select(F.col("kind").alias("atom_id"), "scene_key", "score"))


def _of_members(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate kinds to candidate atoms."""
    return candidates.withColumnRenamed("atom_id", "kind").join(members.select("kind", "atom_id").distinct(), "kind").drop("kind")


def searched_terms(routed: DataFrame, scenes: DataFrame) -> DataFrame:
    """Terms that expansions search in atoms apart from the focus of a round: words of the scenes and fixed terms."""
    fixed = sorted({*V.EXCEPTION_FOCUS_TERMS, *[term for _, terms, _ in V.SEMANTIC_BUCKETS.values() for term in terms]})
    codes = routed.select(F.explode("module_codes").alias("module_code")).distinct()
    named = scenes.join(codes, "module_code", "left_semi").select(F.explode(F.concat(F.array("scene_name"), "scene_terms")).alias("term"))
    return named.union(routed.sparkSession.createDataFrame([(term,) for term in fixed], "term string"))


class LoopStore:
    """The frames of each finished round of a loop in a folder; a round counts once its mark is written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], "round int").write.mode("append").parquet(f"{path}/marks")  # so that it can be read from the start

    def rounds(self) -> int:
        return self.spark.read.schema("round int").parquet(f"{self.path}/marks").agg(F.max("round")).first()[0] or 0

    def save(self, number: int, frames: Mapping[str, DataFrame]) -> None:
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{self.path}/round-{number}/{name}")
        self.spark.createDataFrame([(number,)], "round int").write.mode("append").parquet(f"{self.path}/marks")

    def load(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/round-{number}/{name}")


def resume_candidates(fresh: DataFrame, earlier: DataFrame, compat: bool = True) -> DataFrame:
    """Candidates of an earlier report joined to fresh ones (I21); ``earlier``: query_id, atom_id, score, reasons."""
    rows = earlier.select("query_id", "atom_id", F.explode("reasons").alias("reason"), "score")
    each = rows.withColumn("score", F.col("score") if compat else F.col("score") / F.count("*").over(_per_candidate()))
    base = fresh.select("query_id", "atom_id", F.explode("reasons").alias("reason"), (F.col("score") / F.size("reasons")).alias("score"), F.lit(0).alias("ord"))
    return accumulate(base.unionByName(each.withColumn("ord", F.lit(1))))


def _per_candidate():
    return Window.partitionBy("query_id", "atom_id")


# ------------------------------------------------------------------ the loop
def _last_round(parts: list[DataFrame], report: DataFrame) -> DataFrame:
    """Rows of the last round each question took part in."""
    return reduce(DataFrame.unionByName, parts).join(report.select("query_id", F.col("rounds").alias("round")), ["query_id", "round"]).drop("round")


def recall_loop(
    questions: DataFrame, atoms: DataFrame, modules: DataFrame, scenes: DataFrame, matches: DataFrame, segments: DataFrame,
    max_rounds: int = 3, initial_limit: int = 40, judged_atoms: int | None = 18, compat: bool = True,
    focus_limit: int | None = 24, focus_atoms: int | None = 8, profiles: P.Catalog | None = None, store: str | None = None,
) -> dict[str, DataFrame]:
    """All questions through at most ``max_rounds`` rounds together.

    ``store`` is a shared folder that keeps the state after every round. A call that finds rounds there goes on after the last
    complete one, so a loop stopped by its limit or by a lost driver is taken up where it was (I21): the folder belongs to one set of questions.

    ``profiles`` are scene profiles; where a question has one, its rules decide what is missing and when to stop.

    ``questions`` has query_id, question, query, who_terms, scene_keys, scene_names, module_codes. Each
    round is a fixed set of joins over the open questions; its candidates are written out before the
    next round so plans do not grow. Atoms are scored as kinds (:func:`with_kinds`): a round reads all atoms once where it brings
    new terms, and what it writes grows with kinds times questions, not with atoms times questions.
    """
    names = modules.select("code", "module").dropDuplicates(["code"])
    named = questions.select("query_id", F.posexplode("module_codes").alias("at", "code")).join(names, "code")
    listed = named.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "module"))), lambda item: item["module"]).alias("module_names"))
    routed = cut_lineage(questions.join(listed, "query_id", "left").withColumn("module_names", F.coalesce("module_names", words([]))))
    details = [name for name in ATOM_FIELDS if name != "source_document"]
    signed = cut_lineage(signed_atoms(atoms, matches))
    actors = cut_lineage(routed.select(F.explode("who_terms").alias("term")).distinct())
    first_focus = focus_terms(routed, limit=focus_limit).select(F.explode("focus").alias("term"))
    terms = cut_lineage(searched_terms(routed, scenes).union(first_focus).distinct())
    members = leading_members(signed, terms, actors)
    kinds, kind_matches = _as_kinds(members, matches)
    full = lambda ranked, rows: ranked.join(rows.select(*details), "atom_id")
    candidates = cut_lineage(initial_candidates(routed, kinds, modules, scenes, kind_matches, focus_limit))
    current = cut_lineage(full(rank_candidates(_of_members(candidates, members), members, initial_limit), members))
    start = current.groupBy("query_id").agg(F.count("*").alias("initial_count"))
    state = routed.select("query_id").join(start, "query_id", "left").fillna(0).withColumn("stop_reason", F.lit(None).cast("string")).withColumn(
        "decision", F.lit(GO_ON)).withColumn("can_make_final", F.lit(False)).withColumn("rounds", F.lit(0)).withColumn("rule_id", F.lit("")).withColumn("scene_profile_id", F.lit("")).withColumn(
        "missing_dimensions", F.array().cast(DIMENSIONS)).withColumn("directions", F.array().cast(DIRECTIONS))
    state = cut_lineage(state)
    history, checked, focused = [], [], []
    saved = LoopStore(questions.sparkSession, store) if store else None
    done = saved.rounds() if saved else 0
    for number in range(1, done + 1):
        for name, parts in (("history", history), ("checked", checked), ("focused", focused)):
            parts.append(saved.load(number, name))
    if done:
        candidates, current, state, terms = (saved.load(done, name) for name in ("candidates", "current", "state", "terms"))
        members = leading_members(signed, terms, actors)
        kinds, kind_matches = _as_kinds(members, matches)
    for number in range(done + 1, max_rounds + 1):
        if number > 1 and state.filter(F.col("stop_reason").isNull()).isEmpty():
            break
        open_ids = state.filter(F.col("stop_reason").isNull()).select("query_id")
        asked = routed.join(open_ids, "query_id", "left_semi")
        now = current.join(open_ids, "query_id", "left_semi")
        seen = evidence_rows(now, judged_atoms)
        judged = recall_judgement(recall_facts(asked, seen, None if profiles is None else P.profile_facts(asked, seen, profiles)))
        judged = cut_lineage(judged.select("query_id", "scene_profile_id", "rule_id", "decision", "can_make_final", "confidence", "missing_dimensions", "directions", "evidence_count", "structural_gap_count"))
        picked = atoms_to_analyse(now)
        analysis = cut_lineage(atom_analysis(picked, asked, None if profiles is None else P.atom_gaps(asked, picked, profiles)))
        going = judged.filter(F.col("decision") != STOP)
        wanted = F.array_distinct(F.transform("directions", lambda item: item["direction"]))
        wanted = F.when(F.size("directions") > 0, wanted).otherwise(words(["D", "E"]))
        active = asked.join(going.select("query_id", wanted.alias("wanted")), "query_id")
        checked.append(analysis.withColumn("round", F.lit(number)))
        focus = cut_lineage(focus_terms(asked, now, analysis, focus_limit, focus_atoms))
        focused.append(focus.withColumn("round", F.lit(number)))
        added = cut_lineage(focus.select(F.explode("focus").alias("term")).distinct().join(terms, "term", "left_anti"))
        if not added.isEmpty():  # more terms tell more kinds apart, each of which was a part of one kind before
            before, terms = terms, cut_lineage(terms.union(added))
            members = leading_members(signed, terms, actors)
            heads = members.filter(F.col("place") == 1).withColumnRenamed("kind", "part")
            parts_of = cut_lineage(with_kinds(heads, before, actors).select("kind", "part").distinct())
            candidates = candidates.withColumnRenamed("atom_id", "kind").join(parts_of, "kind").drop("kind").withColumnRenamed("part", "atom_id")
            kinds, kind_matches = _as_kinds(members, matches)
        grown = expand(active, now.join(going.select("query_id"), "query_id", "left_semi"), kinds, modules, scenes, kind_matches, segments, focus, gap_profiles(going, analysis))
        candidates = cut_lineage(merge_expansions(candidates, grown, compat))
        limits = state.select("query_id", (F.greatest(F.lit(initial_limit), F.col("initial_count")) + number * 8).alias("_limit"))
        moving = candidates.join(going.select("query_id"), "query_id", "left_semi").join(limits, "query_id")
        renewed = full(rank_candidates(_of_members(moving, members), members, F.col("_limit")).drop("_limit"), members)
        fresh = renewed.select("query_id", "atom_id").join(now.select("query_id", "atom_id"), ["query_id", "atom_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("new_count"))
        kept = current.join(going.select("query_id"), "query_id", "left_anti")
        following = cut_lineage(kept.unionByName(renewed))
        verdict = judged.join(fresh, "query_id", "left").fillna(0, ["new_count"])
        verdict = cut_lineage(verdict.withColumn("new_stop", F.when(F.col("decision") == STOP, "llm_stop").when(F.col("new_count") == 0, "no_new_candidates")))
        history.append(verdict.select("query_id", F.lit(number).alias("round"), "rule_id", "decision", "evidence_count", "structural_gap_count", "new_count", F.size("directions").alias("direction_count")))
        fields_now = ["scene_profile_id", "rule_id", "decision", "can_make_final", "missing_dimensions", "directions"]
        update = verdict.select("query_id", "new_stop", *[F.col(name).alias(f"n_{name}") for name in fields_now])
        joined = state.join(update, "query_id", "left")
        touched = F.col("n_decision").isNotNull()
        state = cut_lineage(joined.select(
            "query_id", "initial_count", F.coalesce("stop_reason", "new_stop").alias("stop_reason"),
            *[F.when(touched, F.col(f"n_{name}")).otherwise(F.col(name)).alias(name) for name in fields_now],
            F.when(touched, number).otherwise(F.col("rounds")).alias("rounds")))
        current = following
        if saved:
            saved.save(number, {"candidates": candidates, "current": current, "state": state, "terms": terms, "history": history[-1], "checked": checked[-1], "focused": focused[-1]})
    final = state.withColumn("stop_reason", F.coalesce("stop_reason", F.lit("max_rounds"))).withColumnRenamed("decision", "judge_final_decision")
    exhausted = (F.col("stop_reason") == "no_new_candidates") & (F.col("judge_final_decision") == GO_ON)
    sizes = current.groupBy("query_id").agg(F.count("*").alias("final_count"))
    report = final.withColumn("final_decision", F.when(exhausted, STOP).otherwise(F.col("judge_final_decision"))).join(sizes, "query_id", "left").fillna(0, ["final_count"])
    every = _of_members(candidates, with_kinds(signed, terms, actors))  # the candidates of all atoms, read only where they are used
    return {"report": report, "evidence": current, "candidates": every, "rounds": reduce(DataFrame.unionByName, history), "routed": routed, "analysis": _last_round(checked, report), "focus": _last_round(focused, report)}


# ------------------------------------------------------------------ summary
def gap_type(value: str | Column) -> Column:
    body = clean_text(value)
    return first_match([(has_any(body, keywords), F.lit(name)) for name, keywords in V.GAP_TYPE_RULES], F.lit(V.OTHER_GAP))


def _by_type(table: dict[str, str], kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(part) for pair in table.items() for part in pair]), kind)


def missing_summary(judged: Column, analysis: Column) -> Column:
    """Readable gap lines, at most 12 (I30); arrays of (dimension, reason) and (atom_id, missing_elements, next_split_focus)."""
    dims = F.transform(judged, lambda item: F.concat_ws(": ", F.nullif(item["dimension"], F.lit("")), F.nullif(item["reason"], F.lit(""))))
    line = lambda item: F.concat(item["atom_id"], F.lit(": 缺少"), F.array_join(F.slice(item["missing_elements"], 1, 4), "；"), F.lit("；建议继续拆到"), item["next_split_focus"])
    atoms = F.transform(F.filter(analysis, lambda item: F.size(item["missing_elements"]) > 0), line)
    return F.slice(F.array_distinct(F.filter(F.concat(dims, atoms), lambda item: item != "")), 1, 12)


def gap_diagnosis(lines: str, stop_reason: str = "stop_reason") -> Column:
    """Typed gaps with severity, scope and handling, at most 8."""
    exhausted = F.col(stop_reason) == "no_new_candidates"

    def typed(line: Column) -> Column:
        kind = gap_type(line)
        scope = _by_type(V.GAP_SCOPE, kind)
        handling = (
            F.when(exhausted & (scope == "全局阻断"), "建议补充语料或人工补证后再下结论")
            .when(exhausted & (scope == "子结论阻断"), "建议转人工复核，允许输出阶段性判断，但不要直接给出完整确定性结论")
            .when(exhausted, "保留为风险提示，交由人工复核确认").when(scope == "全局阻断", "必须继续补召回，否则不能下最终结论")
            .when(scope == "子结论阻断", "优先继续补召回；若后续候选耗尽，可转人工复核").otherwise("可先保留为风险提示，不必单独阻断整案")
        )
        return F.struct(line.alias("gap_text"), kind.alias("gap_type"), scope.alias("impact_scope"), _by_type(V.GAP_SEVERITY, kind).alias("severity"),
                        handling.alias("handling"), _by_type(V.GAP_CONDITIONS, kind).alias("judgement_condition"))

    return F.slice(F.transform(F.array_distinct(lines), typed), 1, 8)


def gap_cards(gaps: str) -> Column:
    """Count, status and leading types of the three gap cards."""
    scope = lambda gap: gap["impact_scope"]
    cards = [
        ("fatal_gaps", lambda gap: scope(gap) == "全局阻断"), ("reviewable_gaps", lambda gap: scope(gap) == "子结论阻断"),
        ("risk_notice_gaps", lambda gap: ~scope(gap).isin("全局阻断", "子结论阻断")),
    ]
    one = lambda key, items: F.struct(
        F.lit(key).alias("card_key"), F.size(items).alias("count"), F.when(F.size(items) > 0, "有缺口").otherwise("无缺口").alias("card_status"),
        F.slice(F.array_distinct(F.transform(items, lambda gap: gap["gap_type"])), 1, 4).alias("gap_types"))
    return F.array(*[one(key, F.filter(gaps, test)) for key, test in cards])


def evidence_brief() -> Column:
    body = truncate(F.coalesce(*[F.nullif(clean_text(name), F.lit("")) for name in ("how", "what", "content_original")], F.lit("")), 110)
    doc = F.when(strip("source_document") != "", F.concat(F.lit("《"), strip("source_document"), F.lit("》"))).otherwise("")
    lead = F.concat(doc, strip("article_reference"))
    return F.when((lead != "") & (body != ""), F.concat_ws("：", lead, body)).otherwise(F.concat(body, lead))


def evidence_buckets(current: DataFrame, focus: DataFrame, most_rows: int | None = 24, most_focus: int | None = 12) -> DataFrame:
    """Seven bucket lists from the twelve best evidence rows of each question."""
    terms = F.col("focus") if most_focus is None else F.slice("focus", 1, most_focus)
    rows = evidence_rows(current, most_rows).join(focus.select("query_id", terms.alias("focus")), "query_id", "left")
    wide, narrow = _blob("what", "how", "where", "content_original", "source_document"), _blob("what", "how", "where", "content_original")
    found = F.size(F.filter(F.coalesce("focus", words([])), lambda term: F.contains(wide, term)))
    best = top_rows(rows.withColumn("rescored", F.col("score") + found * 4), ["query_id"], [F.desc("rescored"), F.col("atom_id")], 12, "place")
    tests = [("key_basis", F.lit(True), 6)]
    for name, types, keywords, limit in V.EVIDENCE_BUCKETS:
        test = F.col("rule_type").isin(types) | has_any(narrow, keywords) if types else has_any(narrow, keywords)
        tests.append((name, test | narrow.rlike(r"\d") if name == "time_limits" else test, limit))
    briefs = best.withColumn("brief", evidence_brief())
    out = briefs.groupBy("query_id").agg(*[F.sort_array(F.collect_list(F.when(test & (F.col("brief") != ""), F.struct("place", "brief")))).alias(name) for name, test, _ in tests])
    for name, _, limit in tests:
        out = out.withColumn(name, F.slice(F.array_distinct(F.transform(name, lambda item: item["brief"])), 1, limit))
    return out


def summarise(result: dict[str, DataFrame]) -> DataFrame:
    """Summary row per question: buckets, gaps, cards, readiness, next step, risks."""
    report, current = result["report"], result["evidence"]
    lead = F.concat(split_focus_terms("question"), split_focus_terms("query"), "who_terms", "scene_names", F.coalesce("last", words([])))
    focus = result["routed"].join(result["focus"].withColumnRenamed("focus", "last"), "query_id", "left").select(
        "query_id", F.slice(F.array_distinct(F.filter(lead, lambda term: term != "")), 1, 24).alias("focus"))
    checks = result["analysis"].groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("position", F.struct("atom_id", "missing_elements", "next_split_focus").alias("a")))), lambda item: item["a"]).alias("checks"))
    ambiguous = current.filter(F.col("rank") <= 24).groupBy("query_id").agg(F.count_if(is_true("is_ambiguous")).alias("ambiguity_count"))
    out = report.join(evidence_buckets(current, focus), "query_id", "left").join(checks, "query_id", "left").join(ambiguous, "query_id", "left").fillna(0, ["ambiguity_count"])
    for name in ("key_basis", *[bucket for bucket, *_ in V.EVIDENCE_BUCKETS]):
        out = out.withColumn(name, F.coalesce(name, words([])))
    empty = F.filter(F.array(F.struct(F.lit("").alias("atom_id"), words([]).alias("missing_elements"), F.lit("").alias("next_split_focus"))), lambda _: F.lit(False))
    lines = missing_summary(F.col("missing_dimensions"), F.coalesce("checks", empty))
    out = out.withColumn("missing_items", F.slice(lines, 1, 8)).withColumn("gaps", gap_diagnosis("missing_items")).withColumn("cards", gap_cards("gaps"))
    names = F.create_map(*[F.lit(part) for pair in V.DIRECTION_NAMES.items() for part in pair])
    said = F.transform("directions", lambda item: F.concat(item["direction"], F.lit(" "), F.element_at(names, item["direction"]), F.lit("："), item["reason"]))
    out = out.withColumn("recommended_directions", F.slice(F.array_distinct(said), 1, 6))
    final, exhausted = F.col("can_make_final"), F.col("stop_reason") == "no_new_candidates"
    blocked = F.exists("gaps", lambda gap: gap["impact_scope"] == "全局阻断")
    partial = (F.size("key_basis") >= 4) & ~blocked & (F.size("missing_items") <= 3)
    readiness = F.when(final, "ready").when(exhausted & partial, "exhausted_partial").when(exhausted, "exhausted_insufficient").otherwise("insufficient_evidence")
    first = lambda name: F.get(name, F.lit(0))
    step = (
        F.when(final, "基于当前证据集生成最终结论卡片，输出结论、依据、缺失项和风险提示。")
        .when(exhausted & partial, F.coalesce(F.concat(F.lit("建议转人工复核，优先核查："), first("missing_items")), F.lit("建议转人工复核，确认剩余限制条件是否影响最终结论。")))
        .when(exhausted, "建议补充法规语料或人工补证，而不是单纯继续增加轮次。")
        .otherwise(F.coalesce(F.concat(F.lit("优先继续补召回："), first("recommended_directions")), F.lit("优先补定义、材料、时限、例外和流程类证据。")))
    )
    risks = F.array_compact(F.array(
        F.when(~final, "当前证据仍未闭环，暂不适合直接输出“可办理/不可办理”的最终结论。"),
        F.when(F.col("stop_reason") == "max_rounds", "本次停止是因为达到轮次上限，不代表缺口已经补齐。"),
        F.when(F.col("judge_final_decision") == GO_ON, "模型仍建议继续补召回，说明现有证据集对关键缺口的覆盖还不够。"),
        F.when(exhausted, "当前召回候选已经耗尽，继续增加轮次通常不会再带来新增证据。"),
        F.when(F.col("ambiguity_count") > 0, F.concat(F.lit("最终证据中仍有 "), F.col("ambiguity_count").cast("string"), F.lit(" 条原子知识带有歧义/复核标记，需要人工再看。"))),
        F.when(F.size("prohibitions") > 0, "已命中限制性/禁止性规则，输出最终结论前需要优先核查是否存在例外条款或授权条款。"),
    ))
    risks = F.concat(risks, F.transform(F.slice("missing_items", 1, 3), lambda item: F.concat(F.lit("关键缺口："), item)))
    return out.withColumn("readiness", readiness).withColumn("next_step", step).withColumn("risk_points", F.slice(F.array_distinct(risks), 1, 6)).drop("checks")


def conclusion_text(value: str | Column) -> Column:
    """External conclusion wording to one of the six conclusions."""
    body = strip(value)
    return (
        F.when(body.isin(V.FINAL_CONCLUSIONS), body).when(has_any(body, ["不可", "不予", "不能"]), "不可办理")
        .when(has_any(body, ["补材料"]) | (has_any(body, ["材料"]) & has_any(body, ["办理"])), "需补材料后办理").when(has_any(body, ["条件"]), "有条件可办理")
        .when(has_any(body, ["人工", "复核"]), "需人工复核").when(has_any(body, ["证据", "召回", "不足"]), "证据不足待补召回")
        .when(has_any(body, ["可办理", "可以办理"]), "可办理").otherwise("需人工复核")
    )


def recall_decision_text(value: str | Column) -> Column:
    body = strip(value)
    return F.when(has_any(body, ["停止"]), STOP).when(has_any(body, ["继续"]) | (body == ""), GO_ON).otherwise(body)


def merge_conclusions(local: DataFrame, external: DataFrame) -> DataFrame:
    """External conclusions over the local ones, field by field, confidence clamped to [0, 1]."""
    joined = local.join(external.select("query_id", conclusion_text("conclusion").alias("x_conclusion"), F.col("confidence").alias("x_confidence")), "query_id", "left")
    usable = F.col("can_make_final") & F.col("x_conclusion").isNotNull()
    return joined.withColumn("conclusion", F.when(usable, F.col("x_conclusion")).otherwise(F.col("conclusion"))).withColumn(
        "confidence", F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x_confidence", F.lit(0.0))))).otherwise(F.col("confidence"))).drop("x_conclusion", "x_confidence")


def report_tables(summary: DataFrame, evidence: DataFrame, analysis: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of a report: evidence, atom analysis, directions, gaps."""
    return {
        "evidence": evidence.select("query_id", "rank", "atom_id", F.round("score", 2).alias("score"), F.array_join("reasons", " | ").alias("reasons"), "source_document", "article_reference"),
        "analysis": analysis.withColumn("missing_elements", F.array_join("missing_elements", " | ")),
        "directions": summary.select("query_id", F.inline("directions")), "gaps": summary.select("query_id", F.inline("gaps")),
    }

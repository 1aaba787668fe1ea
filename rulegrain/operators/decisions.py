"""Final judgement over a facts table: decision tables as CASE WHEN."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions.rules import decision, fact_types, render
from rulegrain.functions.text import has_any, words


def _rule(rule_id, conclusion, status, confidence, summary, follow_up, all_of=(), any_of=()):
    return {
        "rule_id": rule_id, "conclusion": conclusion, "status": status, "confidence": confidence, "summary": summary,
        "follow_up_actions": [follow_up], "all_of": list(all_of), "any_of": list(any_of),
    }


def _is(fact: str, value: Any) -> dict:
    return {"fact": fact, "eq": value}


def _over(fact: str, value: int = 0) -> dict:
    return {"fact": fact, "gt": value}


READY = _is("can_make_final", True)
PENDING, REVIEW = "证据不足待补召回", "需人工复核"

# The ordered final judgement table; the last row is the default.
FINAL_RULES = [
    _rule("upstream_llm_error", PENDING, "not_ready", 0.25, "上游召回判断发生异常，本次最终结论按本地证据做安全回退，不能视为完整合规结论。",
          "先恢复召回链路的模型连通性，再重新执行闭环查验。", [_is("final_decision", "LLM_ERROR")]),
    _rule("dry_run_only", PENDING, "not_ready", 0.25, "当前仅完成本地召回摘要，尚未进入完整闭环判断，不能直接输出最终合规结论。",
          "继续执行闭环召回，再进入最终合规查验。", [_is("final_decision", "DRY_RUN")]),
    _rule("fatal_gap_blocks_case", PENDING, "not_ready", 0.28, "当前仍存在整案级阻断缺口，证据未闭环，不能输出确定性最终结论。",
          "优先补齐整案级阻断缺口，再判断能否进入最终结论。", [_over("fatal_gap_count")]),
    _rule("exhausted_reviewable_gap", REVIEW, "exhausted_partial", 0.4, "召回候选已基本耗尽，现有证据足以支撑阶段性判断，但仍存在子结论阻断缺口，建议转人工复核。",
          "转人工复核，重点核查剩余子结论阻断缺口。",
          [_is("stop_reason", "no_new_candidates"), _is("fatal_gap_count", 0), _over("reviewable_gap_count")]),
    _rule("not_ready_needs_more_recall", PENDING, "not_ready", 0.25, "当前证据尚未闭环，仍需继续补召回或补充法规依据后，才能形成最终合规结论。",
          "继续补召回，并优先处理当前缺口最高的方向。", [_is("can_make_final", False)]),
    _rule("conflicting_prohibition_and_exception", REVIEW, "generated", 0.38, "当前证据同时命中限制性规则与例外条款，边界尚未完全消解，建议人工复核后再下结论。",
          "人工复核限制条款与例外条款的适用边界。", [READY, _is("has_conflicting_rules", True)]),
    _rule("prohibition_without_exception", "不可办理", "generated", 0.62, "当前证据命中明确限制或禁止性规则，且未发现足以解除限制的例外条款，倾向于不可办理。",
          "如需放行，先补充可覆盖该限制的明确例外依据。", [READY, _over("prohibition_count"), _is("exception_count", 0)]),
    _rule("material_gap_requires_supplement", "需补材料后办理", "generated", 0.58, "当前证据显示办理前仍需补齐关键材料或签章，材料补齐后才适合继续办理。",
          "先补齐关键材料或签章，再重新确认办理结论。", [READY, _over("missing_item_count")], [_over("material_signal_count")]),
    _rule("high_ambiguity_requires_review", REVIEW, "generated", 0.36, "最终证据中仍存在较多歧义原子，建议人工复核后再输出确定性结论。",
          "人工复核歧义证据，并确认其是否影响最终结论。", [READY, {"fact": "ambiguity_count", "gte": 2}]),
    _rule("reviewable_gap_requires_review", REVIEW, "generated", 0.35, "当前仍保留子结论阻断缺口，适合转人工复核，而不宜直接输出绝对性结论。",
          "转人工复核，重点核查未完全闭环的子结论。", [READY, _over("reviewable_gap_count")]),
    _rule("conditional_approval", "有条件可办理", "generated", 0.48, "当前证据显示该事项并非绝对禁止，但需满足材料、动作、时限或例外条件后方可办理。",
          "按当前条件清单逐项核验后，再执行办理动作。", [READY, _over("conditional_signal_count")]),
    _rule("clear_approval", "可办理", "generated", 0.55, "当前证据已基本闭环，且未识别到阻断性限制，倾向于可办理。",
          "保留关键依据与核验记录后执行办理。", [READY, _over("key_basis_count")]),
    _rule("fallback_manual_review", REVIEW, "generated", 0.3, "当前证据已接近闭环，但仍不适合自动输出绝对性结论，建议人工复核。", "人工复核剩余不确定项。"),
]

MATERIAL_ITEM_WORDS = ["材料", "证明", "证件", "凭证", "印鉴", "签章", "原件", "复印件"]
GAP_FACTS = {
    "material_gap_count": "材料缺口", "process_gap_count": "流程动作缺口", "threshold_gap_count": "时限阈值缺口",
    "exception_gap_count": "例外/禁止缺口", "definition_gap_count": "定义范围缺口", "scope_gap_count": "主体范围缺口",
    "judgement_gap_count": "判断条件缺口", "norm_basis_gap_count": "规范依据缺口", "fact_check_gap_count": "事实核验缺口",
}


def final_facts(reports: DataFrame, most: int | None = 12) -> DataFrame:
    """Facts of each report (J3); a bucket counts at most ``most`` entries, as the reference has it, or all with None.

    ``reports`` has query_id, final_decision, stop_reason, can_make_final, ambiguity_count,
    gaps array<struct<gap_type, impact_scope>> and the bucket arrays key_basis, required_materials,
    required_actions, prohibitions, exceptions, time_limits, missing_items.
    """
    scope_count = lambda test: F.size(F.filter("gaps", test))
    size = lambda name: F.size(F.array_distinct(name) if most is None else F.slice(F.array_distinct(name), 1, most))
    scope = lambda gap: gap["impact_scope"]
    out = (
        reports.withColumn("fatal_gap_count", scope_count(lambda gap: scope(gap) == "全局阻断"))
        .withColumn("reviewable_gap_count", scope_count(lambda gap: scope(gap) == "子结论阻断"))
        .withColumn("risk_notice_gap_count", scope_count(lambda gap: ~scope(gap).isin("全局阻断", "子结论阻断")))
    )
    for fact, column in [
        ("key_basis_count", "key_basis"), ("required_material_count", "required_materials"), ("required_action_count", "required_actions"),
        ("prohibition_count", "prohibitions"), ("exception_count", "exceptions"), ("time_limit_count", "time_limits"),
        ("missing_item_count", "missing_items"),
    ]:
        out = out.withColumn(fact, size(column))
    def of_type(kind: str):
        return lambda gap: gap["gap_type"] == kind

    for fact, kind in GAP_FACTS.items():
        out = out.withColumn(fact, scope_count(of_type(kind)))
    missing_material = F.size(F.filter("missing_items", lambda item: has_any(item, MATERIAL_ITEM_WORDS)))
    return (
        out.withColumn("missing_material_item_count", missing_material)
        .withColumn("material_signal_count", F.col("material_gap_count") + F.col("missing_material_item_count"))
        .withColumn("conditional_signal_count", F.col("required_action_count") + F.col("exception_count") + F.col("time_limit_count"))
        .withColumn("has_conflicting_rules", (F.col("prohibition_count") > 0) & (F.col("exception_count") > 0))
    )


def final_judgement(facts: DataFrame, rules: list[Mapping[str, Any]] = FINAL_RULES, scene_rules: Mapping[str, list[Mapping[str, Any]]] | None = None) -> DataFrame:
    """First matching rule per report as columns.

    ``scene_rules`` holds rules of scene profiles by profile id; they go before the others, for reports whose
    ``scene_profile_id`` is theirs (J14). With that column, ``matched_rules`` names the profile and the rule.
    """
    scenes = [{**rule, "all_of": [_is("scene_profile_id", name), *rule.get("all_of", ())], "any_of": list(rule.get("any_of", ()))}
              for name, listed in (scene_rules or {}).items() for rule in listed]
    ordered = [*scenes, *rules]
    for_trace = [
        {**rule, "trace": [*map(render, rule["all_of"]), *([" OR ".join(map(render, rule["any_of"]))] if rule["any_of"] else [])]}
        for rule in ordered
    ]
    fields = ["rule_id", "conclusion", "status", "confidence", "summary", "follow_up_actions", "trace"]
    out = facts.withColumn("_d", decision(for_trace, fact_types(facts), fields)).select("*", "_d.*").drop("_d")
    if "scene_profile_id" not in facts.columns:
        return out
    named = F.filter(F.array(F.coalesce("scene_profile_id", F.lit("")), F.col("rule_id")), lambda name: name != "")
    return out.withColumn("matched_rules", named)


def follow_up(rule_actions: Column, directions: Column, next_step: Column) -> Column:
    """Rule actions, up to four directions and the next step; at most five."""
    step = F.when(next_step != "", F.array(next_step)).otherwise(words([]))
    merged = F.concat(rule_actions, F.slice(directions, 1, 4), step)
    return F.slice(F.array_distinct(F.filter(merged, lambda item: item != "")), 1, 5)

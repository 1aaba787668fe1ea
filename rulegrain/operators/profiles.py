"""Scene profiles: rule tables that hold for the questions of one scene, evaluated for all questions together.

A profile is data: which scenes and keywords call for it, facts derived from the question and its evidence, and rules over
these facts with a priority, an exception and a prohibition (or requirements that count evidence). Facts are rows
(query_id, fact_id, held), conditions are rows of a disjunctive normal form, and a rule is judged by joining the two.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulegrain.functions.rules import COMPARE, render
from rulegrain.functions.text import has_any, strip, text, words

# The parts of a rule with what holds where the part is absent.
PARTS = {"applies_if": True, "requires": True, "exception_if": False, "forbids": False}
ON_FAIL = ["gap_type", "impact_scope", "severity", "handling", "judgement_condition", "conclusion_hint"]

_WAYS = "array<struct<direction:string,reason:string>>"
_PROFILES = "profile_id string, position int, scene_names array<string>, question_keywords array<string>, min_evidence_count int, min_direct_basis_count int"
_FACTS = "profile_id string, fact_id string, source string, mode string, keywords array<string>, rule_types array<string>"
_RULES = f"profile_id string, rule_id string, priority int, atom_label string, dimension string, reason string, {', '.join(f'{name} string' for name in ON_FAIL)}, ways {_WAYS}, decision_trace array<string>"
_LITERALS = "profile_id string, rule_id string, part string, clause int, fact_id string, operator string, value string, negated boolean"
_REQUIREMENTS = (
    f"profile_id string, position int, fact_id string, label string, mode string, always_required boolean, activate_if_who_terms boolean, question_keywords array<string>, "
    f"evidence_keywords array<string>, evidence_rule_types array<string>, min_evidence_hits int, reason string, atom_label string, ways {_WAYS}")


def normal_form(spec: Any, negated: bool = False) -> list[list[tuple[str, str, Any, bool]]]:
    """A condition as clauses, one of which must hold; a clause is a list of (fact, operator, value, negated) that hold together.

    True is one empty clause, false is none.
    """
    if spec is None:
        spec = True
    if isinstance(spec, bool):
        return [[]] if spec != negated else []
    if "not" in spec:
        return normal_form(spec["not"], not negated)
    for name, together in (("all", True), ("any", False)):
        if name in spec:
            parts = [normal_form(item, negated) for item in spec[name]]
            if together != negated:
                return [sum(chosen, []) for chosen in product(*parts)]
            return [clause for part in parts for clause in part]
    if not spec.get("fact"):
        raise ValueError(f"a condition without a fact: {spec!r}")
    operator = next((name for name in COMPARE if name in spec), "falsy" if spec.get("falsy") else "truthy")
    return [[(spec["fact"], operator, spec.get(operator), negated)]]


@dataclass(frozen=True)
class Catalog:
    """The tables of some profiles: as large as the hand-written catalog, not as the data."""

    profiles: DataFrame
    facts: DataFrame
    rules: DataFrame
    literals: DataFrame
    requirements: DataFrame


def _pairs(ways: Sequence) -> list[tuple[str, str]]:
    return [(way["direction"], way["reason"]) if isinstance(way, Mapping) else tuple(way) for way in ways]


def catalog(spark: SparkSession, profiles: Sequence[Mapping[str, Any]]) -> Catalog:
    """Tables of profile specifications. Facts that a rule names must be derived by its profile."""
    heads, facts, rules, literals, requirements = [], [], [], [], []
    for position, profile in enumerate(profiles):
        name = profile["profile_id"]
        heads.append((name, position, list(profile.get("scene_names", ())), list(profile.get("question_keywords", ())),
                      int(profile.get("min_evidence_count") or 6), int(profile.get("min_direct_basis_count") or 3)))
        known = set()
        for spec in profile.get("derived_facts", ()):
            if (spec["source"], spec["mode"]) not in DERIVED:
                raise ValueError(f"unknown source and mode: {spec!r}")
            known.add(spec["fact_id"])
            facts.append((name, spec["fact_id"], spec["source"], spec["mode"], list(spec.get("keywords", ())), list(spec.get("rule_types", ()))))
        for rule in profile.get("rule_specs", ()):
            fail = rule.get("on_fail") or {}
            label = fail.get("atom_label") or rule.get("label", "")
            trace = [f"{part.upper()} {render(rule.get(part))}" for part in PARTS]
            rules.append((name, rule["rule_id"], int(rule.get("priority") or 0), label, fail.get("dimension") or label or rule["rule_id"],
                          fail.get("reason") or f"{rule['rule_id']} 未满足", *[fail.get(key, "") for key in ON_FAIL], _pairs(fail.get("recall_directions", ())), trace))
            for part, absent in PARTS.items():
                for clause, held in enumerate(normal_form(rule[part] if part in rule else absent)):
                    if {fact for fact, *_ in held} - known:
                        raise ValueError(f"{rule['rule_id']} names a fact that {name} does not derive")
                    # an empty clause holds always: it is a row without a fact
                    for fact, operator, value, negated in held or [(None, "truthy", None, False)]:
                        values = value if isinstance(value, (list, tuple, set)) else [value]
                        literals.append((name, rule["rule_id"], part, clause, fact, operator, "\x1f".join(_word(item) for item in values), negated))
        if not profile.get("rule_specs"):  # rules win over requirements
            for at, item in enumerate(profile.get("requirements", ())):
                requirements.append((
                    name, at, item["fact_id"], item.get("label", ""), item.get("mode", "keyword"), bool(item.get("always_required")), bool(item.get("activate_if_who_terms")),
                    list(item.get("question_keywords", ())), list(item.get("evidence_keywords", ())), list(item.get("evidence_rule_types", ())),
                    int(item.get("min_evidence_hits") or 1), item.get("reason", ""), item.get("atom_label") or item.get("label", ""), _pairs(item.get("directions", ()))))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Catalog(make(heads, _PROFILES), make(facts, _FACTS), make(rules, _RULES), make(literals, _LITERALS), make(requirements, _REQUIREMENTS))


def _word(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else "" if value is None else str(value)


# ------------------------------------------------------------------ profile of a question
def detect(questions: DataFrame, known: Catalog) -> DataFrame:
    """query_id and profile_id of the first profile with a scene hit and a keyword hit, for questions that have one.

    A scene hits when either name contains the other; blank names never do.
    """
    scenes = F.filter(F.transform("scene_names", strip), lambda name: name != "")
    asked = questions.select("query_id", strip("question").alias("question"), scenes.alias("asked_scenes"))
    heads = F.sort_array(F.collect_list(F.struct("position", "profile_id", "scene_names", "question_keywords"))).alias("profiles")
    listed = known.profiles.agg(heads)  # one row: the catalog is read inside the row, without pairing questions and profiles
    near = lambda item: F.exists("asked_scenes", lambda name: F.exists(item["scene_names"], lambda other: F.contains(name, other) | F.contains(other, name)))
    said = lambda item: F.exists(item["question_keywords"], lambda word: F.contains(F.col("question"), word))
    found = F.get(F.filter("profiles", lambda item: near(item) & said(item)), F.lit(0))["profile_id"]
    return asked.join(F.broadcast(listed)).select("query_id", found.alias("profile_id")).filter("profile_id IS NOT NULL")


# ------------------------------------------------------------------ derived facts
def _blob() -> Column:
    return F.concat_ws("\n", *[text(name) for name in ("who", "what", "how", "where", "content_original", "source_document")])


def _actors() -> Column:
    return F.concat_ws("\n", text("who"), text("what"), text("how"))


def _in_scope() -> Column:
    return F.exists("who_terms", lambda term: F.contains(F.col("actors"), term))


def _some(body: str, item: Column) -> Column:
    return F.exists(item["keywords"], lambda word: F.contains(F.col(body), word))


# Source and mode of a derived fact; each is a test over one row.
DERIVED = {
    ("who_terms", "non_empty"): lambda item: F.size("who_terms") > 0,
    ("question", "keyword_any"): lambda item: _some("question", item),
    ("question", "keyword_all"): lambda item: F.forall(item["keywords"], lambda word: F.contains(F.col("question"), word)),
    ("evidence", "actor_scope"): lambda item: _in_scope(),
    ("evidence", "keyword_any"): lambda item: _some("blob", item),
    ("evidence", "rule_type_any"): lambda item: F.array_contains(item["rule_types"], F.col("rule_type")),
    ("evidence", "keyword_or_rule"): lambda item: _some("blob", item) | F.array_contains(item["rule_types"], F.col("rule_type")),
}


def _held(rows: DataFrame, key: list[str], on_evidence: bool) -> DataFrame:
    """Facts that some row of a key holds; only hits leave the row, and they merge before the shuffle."""

    def test(item: Column) -> Column:
        out = F.lit(False)
        for (source, mode), held in DERIVED.items():
            if (source == "evidence") == on_evidence:
                out = F.when((item["source"] == source) & (item["mode"] == mode), held(item)).otherwise(out)
        return out

    hits = F.transform(F.filter("specs", test), lambda item: item["fact_id"])
    return rows.select(*key, F.explode(hits).alias("fact_id")).distinct()


def _prepared(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = evidence.withColumn("blob", _blob()).withColumn("actors", _actors()).withColumn("rule_type", strip("rule_type"))
    return rows.join(asked, "query_id")


def derived_facts(questions: DataFrame, evidence: DataFrame, known: Catalog, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """One row (key, profile_id, fact_id, held) per question with a profile and fact of that profile.

    ``key`` may also name the atom, so that each piece of evidence is judged alone.
    """
    found = detect(questions, known)
    specs = known.facts.groupBy("profile_id").agg(F.collect_list(F.struct("fact_id", "source", "mode", "keywords", "rule_types")).alias("specs"))
    asked = questions.select("query_id", strip("question").alias("question"), _terms()).join(found, "query_id").join(specs, "profile_id")
    seen = _prepared(asked, evidence)
    every = asked if list(key) == ["query_id"] else asked.join(evidence.select(*key).distinct(), "query_id")
    hits = _held(seen, list(key), True).unionByName(_held(every, list(key), False)).withColumn("held", F.lit(True))
    wanted = every.select(*key, "profile_id", F.explode("specs.fact_id").alias("fact_id"))
    return wanted.join(hits, [*key, "fact_id"], "left").fillna(False, ["held"]).select(*key, "profile_id", "fact_id", "held")


def _terms() -> Column:
    return F.filter(F.transform("who_terms", strip), lambda term: term != "").alias("who_terms")


# ------------------------------------------------------------------ rules and requirements
def _literal_holds() -> Column:
    """Whether a literal holds for a boolean fact: comparisons read it as 1 or 0 and as true or false."""
    word, number = F.col("held").cast("string"), F.col("held").cast("int").cast("double")
    value, listed = F.col("value"), F.split("value", "\x1f")
    limit = F.when(value.isin("true", "false"), (value == "true").cast("double")).otherwise(F.expr("try_cast(value AS double)"))
    tests = {
        "truthy": F.col("held"), "falsy": ~F.col("held"), "eq": (word == value) | F.coalesce(number == limit, F.lit(False)),
        "gt": number > limit, "gte": number >= limit, "lt": number < limit, "lte": number <= limit, "in": F.array_contains(listed, word)}
    tests["ne"], tests["not_in"] = ~tests["eq"], ~tests["in"]
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(F.col("operator") == name, F.coalesce(test, F.lit(False))).otherwise(out)
    return F.when(F.col("fact_id").isNull(), True).otherwise(out != F.col("negated"))


def rule_states(questions: DataFrame, facts: DataFrame, known: Catalog, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """State of every rule per key: needed, covered, failed and the parts, with position by priority (high first), then rule id.

    A rule fails when it applies, no exception holds, and its requirement is unmet or its prohibition met.
    """
    keys = list(key)
    with_profile = facts.select(*keys, "profile_id").distinct()
    literals = with_profile.join(known.literals, "profile_id").join(facts.select(*keys, "fact_id", "held"), [*keys, "fact_id"], "left")
    clauses = literals.withColumn("held", F.coalesce("held", F.lit(False))).groupBy(*keys, "profile_id", "rule_id", "part", "clause").agg(F.bool_and(_literal_holds()).alias("held"))
    parts = clauses.groupBy(*keys, "profile_id", "rule_id").agg(*[F.coalesce(F.bool_or(F.when(F.col("part") == part, F.col("held"))), F.lit(False)).alias(part) for part in PARTS])
    joined = with_profile.join(known.rules, "profile_id").join(parts, [*keys, "profile_id", "rule_id"], "left").fillna(False, list(PARTS))
    failed = F.col("applies_if") & ~F.col("exception_if") & (~F.col("requires") | F.col("forbids"))
    rows = joined.withColumn("failed", failed).withColumn("covered", F.col("applies_if") & ~failed)
    order = F.struct((-F.col("priority")).alias("down"), F.col("rule_id")).alias("position")
    return rows.select(
        *keys, "profile_id", "rule_id", "priority", order, F.col("applies_if").alias("needed"), "covered", "failed", F.col("requires").alias("requirement_met"),
        F.col("exception_if").alias("exception_hit"), F.col("forbids").alias("forbid_hit"), "atom_label", "dimension", "reason", *ON_FAIL, "ways", "decision_trace")


def requirement_states(questions: DataFrame, evidence: DataFrame, known: Catalog, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """The same states for profiles that list requirements: enough evidence rows per requirement."""
    keys = list(key)
    found = detect(questions, known)
    asked = questions.select("query_id", strip("question").alias("question"), _terms()).join(found, "query_id")
    every = asked if keys == ["query_id"] else asked.join(evidence.select(*keys).distinct(), "query_id")
    wanted = every.join(known.requirements, "profile_id")
    specs = known.requirements.groupBy("profile_id").agg(F.collect_list(F.struct(
        "fact_id", "mode", F.col("evidence_keywords").alias("keywords"), F.col("evidence_rule_types").alias("rule_types"))).alias("specs"))
    test = lambda item: F.when(item["mode"] == "actor_scope", _in_scope()).otherwise(_some("blob", item) | F.array_contains(item["rule_types"], F.col("rule_type")))
    hits = _prepared(asked.join(specs, "profile_id"), evidence).select(*keys, F.explode(F.transform(F.filter("specs", test), lambda item: item["fact_id"])).alias("fact_id"))
    counted = hits.groupBy(*keys, "fact_id").agg(F.count("*").cast("int").alias("hits"))
    needed = F.col("always_required") | (F.col("activate_if_who_terms") & (F.size("who_terms") > 0)) | F.exists("question_keywords", lambda word: F.contains(F.col("question"), word))
    joined = wanted.join(counted, [*keys, "fact_id"], "left").fillna(0, ["hits"]).withColumn("needed", needed).withColumn("covered", F.col("hits") >= F.col("min_evidence_hits"))
    blank = [F.lit("").alias(name) for name in ON_FAIL]
    no = F.lit(False)
    return joined.select(
        *keys, "profile_id", F.col("fact_id").alias("rule_id"), F.lit(0).alias("priority"), F.struct(F.col("position").alias("down"), F.col("fact_id").alias("rule_id")).alias("position"),
        "needed", "covered", (F.col("needed") & ~F.col("covered")).alias("failed"), F.col("covered").alias("requirement_met"), no.alias("exception_hit"), no.alias("forbid_hit"),
        "atom_label", F.col("label").alias("dimension"), "reason", *blank, "ways", words([]).alias("decision_trace"))


def states(questions: DataFrame, evidence: DataFrame, known: Catalog, key: Sequence[str] = ("query_id",)) -> DataFrame:
    """Rule and requirement states of all questions with a profile."""
    facts = derived_facts(questions, evidence, known, key)
    return rule_states(questions, facts, known, key).unionByName(requirement_states(questions, evidence, known, key))


# ------------------------------------------------------------------ what the recall loop and the judgement read
def profile_facts(questions: DataFrame, evidence: DataFrame, known: Catalog, most_dimensions: int | None = 8, most_directions: int | None = 6) -> DataFrame:
    """One row per question with a profile: its id, rule counts, evidence limits, missing dimensions and directions by priority.

    Of equal (direction, dimension) pairs the first stays. The reference's limits are arguments; None keeps all.
    """
    rows = states(questions, evidence, known)
    failed = F.when(F.col("failed"), F.struct("position", F.struct("dimension", "reason").alias("gap"), "ways"))
    counted = rows.groupBy("query_id").agg(
        F.count_if("needed").alias("scene_requirement_needed_count"), F.count_if(F.col("needed") & F.col("covered")).alias("scene_requirement_covered_count"),
        F.count_if("failed").alias("scene_requirement_missing_count"), F.sort_array(F.collect_list(failed)).alias("failed"))
    cut = lambda column, most: column if most is None else F.slice(column, 1, most)
    said = F.flatten(F.transform("failed", lambda item: F.transform(item["ways"], lambda way: F.struct(way["direction"], way["reason"], item["gap"]["dimension"].alias("missing_dimension")))))
    ways = F.aggregate(
        cut(said, most_directions), F.slice(said, 1, 0),
        lambda kept, way: F.when(F.exists(kept, lambda old: (old["direction"] == way["direction"]) & (old["missing_dimension"] == way["missing_dimension"])), kept).otherwise(F.concat(kept, F.array(way))))
    limits = known.profiles.select("profile_id", "min_evidence_count", "min_direct_basis_count")
    out = detect(questions, known).join(limits, "profile_id").join(counted, "query_id", "left").fillna(0, [f"scene_requirement_{name}_count" for name in ("needed", "covered", "missing")])
    return out.select(
        "query_id", F.col("profile_id").alias("scene_profile_id"), *[f"scene_requirement_{name}_count" for name in ("needed", "covered", "missing")],
        "min_evidence_count", "min_direct_basis_count", cut(F.transform("failed", lambda item: item["gap"]), most_dimensions).alias("scene_missing_dimensions"), ways.alias("scene_directions"))


def atom_gaps(questions: DataFrame, evidence: DataFrame, known: Catalog) -> DataFrame:
    """query_id, atom_id, labels: what each piece of evidence alone lacks by its question's profile; a row for every such piece."""
    rows = states(questions, evidence, known, ("query_id", "atom_id")).filter("needed")
    lacking = F.when(~F.col("covered") & (F.col("atom_label") != ""), F.struct("position", "atom_label"))
    listed = rows.groupBy("query_id", "atom_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(lacking)), lambda item: item["atom_label"])).alias("scene_labels"))
    every = evidence.select("query_id", "atom_id").distinct().join(detect(questions, known), "query_id")
    return every.join(listed, ["query_id", "atom_id"], "left").select("query_id", "atom_id", F.coalesce("scene_labels", words([])).alias("scene_labels"))

"""Guarded factual answers for a table of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.rules import first_match
from rulegrain.functions.text import collapse_space, has_any, text, words, words_in
from rulegrain.operators import conflicts as C, entities as N
from rulegrain.operators.scale import broadcast_if_small, ordered_distinct, top_rows
from rulegrain.session import cut_lineage

ATOM_FIELDS = ["atom_id", "rule_type", "source_document", "article_reference", "who", "what", "when", "how", "content_original", "is_ambiguous"]


@dataclass(frozen=True)
class Dictionaries:
    """What entity extraction needs; a missing part finds nothing of its kind."""

    actor_terms: DataFrame
    actor_index: N.AliasIndex
    object_index: N.AliasIndex
    object_terms: DataFrame
    time_terms: DataFrame | None = None


# ------------------------------------------------------------------ question reading (H1-H3)
def question_type(question: Column) -> Column:
    """B before C before A; A is the default (H1)."""
    return F.when(has_any(question, V.QUESTION_TYPE_TERMS["B"]), "B").when(has_any(question, V.QUESTION_TYPE_TERMS["C"]), "C").otherwise("A")


def several_intents(question: Column) -> Column:
    """A list separator together with two or more intent words (H2)."""
    body = collapse_space(question)
    return has_any(body, V.LIST_SEPARATORS) & (F.size(words_in(body, V.COMPLEX_INTENT_TERMS)) >= 2)


def with_question_terms(questions: DataFrame, known: Dictionaries) -> DataFrame:
    """Actors (6), objects (8) and times (6) of each question (H3).

    Equal texts are read once: extraction runs over distinct search texts and distinct actor words.
    """
    asked = questions.withColumn("search_text", collapse_space(F.concat_ws(" ", F.nullif(text("question"), F.lit("")), F.nullif(text("query"), F.lit("")))))
    texts = asked.select("search_text").distinct()
    objects = N.object_records(texts, "search_text", "search_text", words([]), known.object_index, known.object_terms)
    times = N.time_records(texts, "search_text", "search_text", words([]), known.time_terms)
    listed = lambda rows, limit, alias: rows.groupBy("search_text").agg(
        F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("order", "record.name"))), lambda pair: pair["name"])), 1, limit).alias(alias)
    )
    named = N.with_matches(texts, F.col("search_text"), known.actor_terms, "listed", "search_text")
    split_who = F.filter(F.transform(F.split(collapse_space("who"), r"[、，,；;|/\t\n]+"), F.trim), lambda term: term != "")
    wanted = asked.select("query_id", "search_text", split_who.alias("spoken")).join(named, "search_text").select(
        "query_id", F.posexplode(F.array_distinct(F.concat("spoken", "listed"))).alias("at", "term")
    )
    distinct_terms = wanted.select(F.col("term").alias("said")).distinct()
    resolved = N.actor_records(distinct_terms, "said", "said", F.array("said"), known.actor_index).select(
        F.col("said").alias("term"), "order", "record.name")
    actors = ordered_distinct(
        wanted.join(resolved, "term").select("query_id", "name", F.struct("at", "order").alias("place")), ["query_id"], "name", "place", 6, "actors"
    )
    out = asked.join(actors, "query_id", "left").join(listed(objects, 8, "objects"), "search_text", "left").join(listed(times, 6, "times"), "search_text", "left")
    for name in ("actors", "objects", "times"):
        out = out.withColumn(name, F.coalesce(name, words([])))
    typed = out.withColumn("question_type", question_type(F.col("question")))
    return cut_lineage(typed.withColumn("several_intents", several_intents(F.col("question"))))  # read by every later step


# ------------------------------------------------------------------ equal questions
SAID = ["question", "query", "who"]


def once_per_question(questions: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` makes of each question; questions that say the same are built once and stored once.

    ``build`` gets and returns a ``query_id`` that stands for all ids with that wording.
    """
    told = cut_lineage(questions.select(*SAID).distinct().withColumn("query_id", F.monotonically_increasing_id().cast("string")))
    built = cut_lineage(build(told)).withColumnRenamed("query_id", "_told")
    spoken = told.select(F.col("query_id").alias("_told"), *[F.col(name).alias(f"_{name}") for name in SAID])
    same = reduce(lambda left, right: left & right, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in SAID])
    ids = questions.select("query_id", *SAID).join(broadcast_if_small(spoken), same).select("query_id", "_told")
    return ids.join(broadcast_if_small(built), "_told").drop("_told")


# ------------------------------------------------------------------ retrieval (H4-H6)
def _by_name(links: DataFrame) -> DataFrame:
    """(name, atom_id) under the name and the normalised name; pairs may repeat."""
    names = F.array_distinct(F.array("name", F.coalesce("normalized_name", "name")))
    return links.select("atom_id", F.explode(names).alias("name"))


def retrieve(questions: DataFrame, atoms: DataFrame, links: dict[str, DataFrame], scene_atoms: DataFrame, limit: int = V.MAX_FORMAL_ATOMS + 1) -> DataFrame:
    """At most ``limit`` candidate rows per question.

    Questions that look for the same things share one retrieval, so a question asked a million
    times costs one lookup. ``links`` maps actor, object, time to (atom_id, name, normalized_name).
    Candidates are ranked by the few fields that decide; only those that stay meet their full atoms.
    """
    asked = questions.withColumn("wanted", F.md5(F.to_json(F.struct("question_type", "actors", "objects", "times"))))
    sets = cut_lineage(asked.select("wanted", "question_type", "actors", "objects", "times").dropDuplicates(["wanted"]).withColumn("_set", F.monotonically_increasing_id()))

    def met(rows: DataFrame, **kinds: str) -> DataFrame:
        """(_set, atom_id) with a flag per kind: whether a term of that kind leads to the atom."""
        parts = [
            broadcast_if_small(rows.select("_set", F.explode(terms).alias("name"))).join(_by_name(links[kind]), "name").select(
                "_set", "atom_id", *[F.lit(kind == other).alias(f"{other}_match") for other in kinds])
            for kind, terms in kinds.items()]
        return reduce(DataFrame.unionByName, parts).groupBy("_set", "atom_id").agg(*[F.max(f"{kind}_match").alias(f"{kind}_match") for kind in kinds])

    info = atoms.select(*ATOM_FIELDS).withColumn("_body", F.xxhash64(*ATOM_FIELDS))
    scenes = scene_atoms.select("atom_id").distinct().withColumn("in_scene", F.lit(True))
    decisive = info.select("atom_id", "_body", "rule_type", "source_document", "article_reference").join(scenes, "atom_id", "left")
    decisive = decisive.withColumn("has_scene_match", F.coalesce("in_scene", F.lit(False))).drop("in_scene")
    count = lambda name: F.col(name).cast("int")
    fields = ["_set", "atom_id", "answer_actor", "answer_object", "actor_match", "object_match", "time_match", "match_count", "last"]

    def of_type(rows: DataFrame, types: list[str]) -> DataFrame:
        return rows.join(decisive.filter(F.col("rule_type").isin(types)), "atom_id").drop("rule_type")

    # A: actor and (object or time)
    a_sets = sets.filter((F.col("question_type") == "A") & (F.size("actors") > 0))
    a_rows = met(a_sets, object="objects", time="times", actor="actors").filter(F.col("actor_match") & (F.col("object_match") | F.col("time_match")))
    a_rows = a_rows.withColumn("match_count", F.lit(1) + count("object_match") + count("time_match"))
    a_rows = of_type(a_rows.withColumns({"answer_actor": F.lit(""), "answer_object": F.lit(""), "last": F.lit("")}).select(*fields), V.TYPE_A_RULE_TYPES)
    # B: object to every actor of its atoms
    b_sets = sets.filter((F.col("question_type") == "B") & (F.size("objects") > 0))
    actors = links["actor"].select("atom_id", F.coalesce("normalized_name", "name").alias("answer_actor")).distinct()
    b_rows = of_type(met(b_sets, object="objects", time="times").filter("object_match"), V.TYPE_B_RULE_TYPES).join(actors, "atom_id")
    b_rows = b_rows.withColumns({
        "answer_object": F.lit(""), "actor_match": F.lit(False), "match_count": F.lit(1) + count("time_match"), "last": F.col("answer_actor")})
    # C: object to its definitions
    c_sets = sets.filter(F.col("question_type") == "C").select("_set", F.explode("objects").alias("asked"))
    objects = links["object"].select("atom_id", "name", F.coalesce("normalized_name", "name").alias("answer_object"))
    by_either = objects.select("atom_id", "answer_object", F.explode(F.array_distinct(F.array("name", "answer_object"))).alias("asked"))
    c_rows = broadcast_if_small(c_sets).join(by_either, "asked").select("_set", "atom_id", "answer_object").distinct()
    c_rows = of_type(c_rows, V.TYPE_C_RULE_TYPES).withColumns({
        "answer_actor": F.lit(""), "actor_match": F.lit(False), "object_match": F.lit(True), "time_match": F.lit(False), "match_count": F.lit(1), "last": F.col("answer_object")})
    ranked = a_rows.unionByName(b_rows.select(*a_rows.columns)).unionByName(c_rows.select(*a_rows.columns))
    order = [F.desc("has_scene_match"), F.desc("match_count"), F.col("source_document"), F.col("article_reference"), F.col("last"), F.col("atom_id")]
    picked = cut_lineage(top_rows(ranked, ["_set"], order, limit).drop("last", "source_document", "article_reference"))
    ids = broadcast_if_small(picked.select("atom_id").distinct())
    full = info.join(ids, "atom_id").distinct()  # equal rows of one id are counted by ``picked``
    first_time = links["time"].join(ids, "atom_id").groupBy("atom_id").agg(F.min("name").alias("first_time"))
    found = picked.join(full, ["atom_id", "_body"]).join(first_time, "atom_id", "left").withColumn("first_time", F.coalesce("first_time", F.lit("")))
    found = cut_lineage(found.join(sets.select("_set", "wanted"), "_set").drop("_set", "_body"))
    return asked.select("query_id", "wanted").join(broadcast_if_small(found), "wanted").drop("wanted")


# ------------------------------------------------------------------ guards (H7-H11), on the atoms of one question
def atom_text(atom: Column) -> Column:
    return F.concat_ws(" ", *[text(atom[name]) for name in ("who", "what", "when", "how", "content_original", "article_reference")])


def keep(atoms: Column, test) -> Column:
    return F.filter(atoms, test)


def outside_scope(question: Column, atom: Column) -> Column:
    """Names of condition scopes the atom has and the question lacks (H7)."""
    return F.array_compact(F.array(*[
        F.when(has_any(atom_text(atom), atom_words) & ~has_any(question, question_words), name)
        for name, atom_words, question_words in V.CONDITION_SCOPES
    ]))


def precise_object_ok(search: Column, atom: Column) -> Column:
    """Every precise object named in the question occurs in the atom (H8)."""
    wanted = words_in(search, V.PRECISE_OBJECT_TERMS)
    return F.forall(wanted, lambda term: F.contains(atom_text(atom), term))


def action_ok(question: Column, atom: Column) -> Column:
    """Some action word of the question occurs in the atom; no action word asks for nothing (H9)."""
    wanted = words_in(question, V.TYPE_B_ACTION_TERMS)
    return (F.size(wanted) == 0) | F.exists(wanted, lambda term: F.contains(atom_text(atom), term))


def good_citation(atom: Column) -> Column:
    return F.contains(text(atom["article_reference"]), F.lit("条")) & ~has_any(atom_text(atom), V.WEAK_EVIDENCE_TERMS)


def material_evidence(atom: Column) -> Column:
    body = atom_text(atom)
    return (atom["rule_type"] != "PER_AUTH") & has_any(body, V.MATERIAL_ACTION_TERMS) & has_any(body, V.MATERIAL_OBJECT_TERMS)


def with_intent_filter(rows: DataFrame, atoms: str = "atoms", alias: str = "intent_atoms") -> DataFrame:
    """Intent stages in order; of the last four, the first that removes something ends the chain."""
    q = F.col("question")
    out = rows.withColumn(alias, keep(F.col(atoms), good_citation)).withColumn("intent_reason", F.when(F.size(alias) != F.size(atoms), "citation_quality"))
    asks = has_any(q, V.PERMISSION_QUESTION_TERMS)
    out = out.withColumn("_next", F.when(asks, keep(F.col(alias), lambda atom: atom["rule_type"] == "PER_AUTH")).otherwise(F.col(alias)))
    out = out.withColumn("intent_reason", F.when(F.size("_next") != F.size(alias), "permission_intent").otherwise(F.col("intent_reason")))
    out = out.withColumn(alias, F.col("_next")).withColumn("_ended", F.lit(False))
    stages = [
        ("cash_intent", V.CASH_QUESTION_TERMS, lambda atom: F.contains(atom_text(atom), F.lit("现金")) & F.contains(atom_text(atom), F.lit("支取"))),
        ("change_intent", V.CHANGE_QUESTION_TERMS, lambda atom: has_any(atom_text(atom), V.CHANGE_QUESTION_TERMS)),
        ("forbidden_intent", V.FORBIDDEN_QUESTION_TERMS, lambda atom: atom["rule_type"] == "PRO_FORBIDDEN"),
        ("material_intent", V.MATERIAL_QUESTION_TERMS, material_evidence),
    ]
    for reason, asked, test in stages:
        active = ~F.col("_ended") & has_any(q, asked)
        out = out.withColumn("_next", F.when(active, keep(F.col(alias), test)).otherwise(F.col(alias)))
        out = out.withColumn("_shrank", F.size("_next") != F.size(alias))
        out = out.withColumn("intent_reason", F.when(F.col("_shrank"), reason).otherwise(F.col("intent_reason")))
        out = out.withColumn("_ended", F.col("_ended") | F.col("_shrank")).withColumn(alias, F.col("_next"))
    return out.drop("_next", "_shrank", "_ended")


# ------------------------------------------------------------------ verdict and answers
def _conflict_counts(rows: DataFrame) -> DataFrame:
    """Conflicts among the remaining atoms of each question, with the rules of conflict detection."""
    exploded = rows.select("query_id", F.posexplode("atoms").alias("row_no", "a")).select("query_id", "row_no", "a.*")
    keyed = exploded.withColumn("atom_key", F.concat_ws("::", "query_id", "atom_id"))
    ready = C.comparable_atoms(keyed.drop("atom_id").withColumnRenamed("atom_key", "atom_id"))
    scoped = ready.withColumn("query_id", F.substring_index("atom_id", "::", 1))
    found = C.scope_conflicts(C.scope_groups(scoped, ("query_id", "scope_key")))
    return found.groupBy("query_id").agg(F.count("*").alias("conflict_count"))


def answer_questions(
    questions: DataFrame, atoms: DataFrame, links: dict[str, DataFrame], scene_atoms: DataFrame, known: Dictionaries,
) -> DataFrame:
    """One row per question: route, fail reason, evidence and answers.

    ``questions`` has query_id (string), question, query, who. After retrieval a question owns at
    most 13 atoms, kept in one array column: every guard is a filter inside the row. Equal questions
    are answered once.
    """
    return once_per_question(questions, lambda told: _answered(told, atoms, links, scene_atoms, known)).select("query_id", *ANSWER_FIELDS)


ANSWER_FIELDS = [
    "question", "query", "who", "question_type", "actors", "objects", "times", "fail_reason", "route", "confidence", "evidence_ids", "answers", "answer_count", "intent_reason"]


def _answered(questions: DataFrame, atoms: DataFrame, links: dict[str, DataFrame], scene_atoms: DataFrame, known: Dictionaries) -> DataFrame:
    read = with_question_terms(questions, known)
    candidates = retrieve(read, atoms, links, scene_atoms)
    fields = [*ATOM_FIELDS, "answer_actor", "answer_object", "actor_match", "object_match", "time_match", "match_count", "has_scene_match", "first_time"]
    clean = candidates.select("query_id", "rank", *[
        (collapse_space(name) if name in ATOM_FIELDS[:-1] else F.col(name)).alias(name) for name in fields
    ])
    gathered = clean.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("a")))).alias("g"))
    rows = read.join(gathered.select("query_id", F.transform("g", lambda item: item["a"]).alias("found")), "query_id", "left")
    # a typed empty array for questions without candidates
    rows = rows.withColumn("found", F.coalesce("found", F.filter(F.array(F.struct(*[
        F.lit(None).cast(kind).alias(name) for name, kind in ((field, dict(clean.dtypes)[field]) for field in fields)])), lambda item: F.lit(False))))
    q, kind = F.col("question"), F.col("question_type")
    any_in = lambda name: F.size(name) > 0
    enough = F.when(kind == "A", any_in("actors") & (any_in("objects") | any_in("times"))).otherwise(any_in("objects"))
    supported = (kind != "C") | has_any(q, V.DEFINITION_QUESTION_TERMS)
    rows = rows.withColumn("precise", keep(F.col("found"), lambda atom: precise_object_ok(F.col("search_text"), atom)))
    rows = with_intent_filter(rows, "precise", "intent_atoms")
    narrowed = (
        F.when(kind == "A", F.col("intent_atoms")).when(kind == "B", keep(F.col("precise"), lambda atom: action_ok(q, atom)))
        .otherwise(keep(F.col("precise"), lambda atom: atom["rule_type"].isin(V.TYPE_C_RULE_TYPES)))
    )
    rows = rows.withColumn("narrowed", narrowed)
    rows = rows.withColumn("rejected", F.when(kind != "C", keep(F.col("narrowed"), lambda atom: F.size(outside_scope(q, atom)) > 0)).otherwise(F.slice("narrowed", 1, 0)))
    rows = cut_lineage(rows.withColumn("atoms", F.col("narrowed")))
    rows = rows.join(_conflict_counts(rows), "query_id", "left").fillna(0, ["conflict_count"])

    def exists(test) -> Column:
        return F.exists("atoms", test)

    blank = lambda column: F.coalesce(column, F.lit("")) == ""
    allowed = F.when(kind == "A", ~exists(lambda a: ~a["rule_type"].isin(V.DETERMINISTIC_RULE_TYPES))).when(
        kind == "B", ~exists(lambda a: ~a["rule_type"].isin(V.TYPE_B_RULE_TYPES))).otherwise(~exists(lambda a: ~a["rule_type"].isin(V.TYPE_C_RULE_TYPES)))
    ambiguous = exists(lambda a: F.lower(a["is_ambiguous"].cast("string")).isin([*V.TRUE_WORDS, "是的"]))
    main_missing = lambda a: F.when(kind == "A", blank(a["how"])).when(kind == "B", blank(a["answer_actor"])).otherwise(blank(a["how"]) & blank(a["content_original"]))
    missing = exists(lambda a: main_missing(a) | blank(a["source_document"]) | blank(a["article_reference"]))
    weak = (kind == "A") & exists(lambda a: ~a["actor_match"] | ~(a["object_match"] | a["time_match"]))
    emptied = lambda before, after: (F.size(before) > 0) & (F.size(after) == 0)
    reason = first_match([
        (F.col("several_intents"), F.lit("complex_multi_intent")), (~supported, F.lit("unsupported_question_type")), (~enough, F.lit("insufficient_entities")),
        (emptied("found", "precise"), F.lit("intent_mismatch")), (emptied("precise", "narrowed"), F.lit("intent_mismatch")),
        (F.size("rejected") > 0, F.lit("unmatched_condition_scope")), (F.size("atoms") == 0, F.lit("no_atoms")),
        (F.size("atoms") > V.MAX_FORMAL_ATOMS, F.lit("too_many_atoms")), (~allowed, F.lit("ambiguous_rule_type")),
        ((kind == "A") & ambiguous, F.lit("ambiguous_atom")), (missing, F.lit("missing_required_fields")), (ambiguous, F.lit("ambiguous_atom")),
        (weak, F.lit("weak_entity_alignment")), (F.col("conflict_count") > 0, F.lit("conflict_detected")),
    ], F.lit(None).cast("string"))
    rows = rows.withColumn("fail_reason", reason)
    evidence = (
        F.when(F.col("fail_reason") == "unmatched_condition_scope", F.col("rejected"))
        .when(F.col("fail_reason") == "intent_mismatch", F.when(F.size("precise") == 0, F.col("found")).otherwise(F.col("precise")))
        .when(F.col("fail_reason").isin("complex_multi_intent", "unsupported_question_type", "insufficient_entities"), F.slice("found", 1, 0))
        .otherwise(F.col("atoms"))
    )
    answers = F.when(F.col("fail_reason").isNull(), F.transform(_answering(kind), lambda atom: _answer(kind, atom)))
    return rows.select(
        "query_id", "question", "query", "who", "question_type", "actors", "objects", "times", "fail_reason",
        F.when(F.col("fail_reason").isNull(), "fast_path").otherwise("slow_path").alias("route"),
        F.when(F.col("fail_reason").isNull(), "formal").otherwise("llm-inferred").alias("confidence"),
        F.transform(evidence, lambda atom: atom["atom_id"]).alias("evidence_ids"),
        answers.alias("answers"), F.coalesce(F.size(answers), F.lit(0)).alias("answer_count"), "intent_reason",
    )


def _answering(kind: Column) -> Column:
    """Atoms that become answers: for type B the first atom of each actor."""
    actors = F.transform("atoms", lambda atom: atom["answer_actor"])
    first = F.filter("atoms", lambda atom, at: F.array_position(actors, atom["answer_actor"]) == at + 1)
    return F.when(kind == "B", first).otherwise(F.col("atoms"))


def _answer(kind: Column, atom: Column) -> Column:
    """Answer text with source, subject, time and detail."""
    doc, ref = text(atom["source_document"]), text(atom["article_reference"])
    source = F.when((doc != "") & (ref != ""), F.concat_ws("·", doc, ref)).otherwise(F.coalesce(F.nullif(doc, F.lit("")), F.nullif(ref, F.lit("")), F.lit("未标注来源")))
    trim_end = lambda value: F.regexp_replace(text(value), "[。；;，, ]+$", "")
    how, original = trim_end(atom["how"]), trim_end(atom["content_original"])
    thin = (F.length(how) <= 8) | how.isin(V.GENERIC_HOW_VALUES)
    detail = F.when((original != "") & thin, original).when(how != "", how).otherwise(original)
    subject = F.coalesce(F.nullif(text(atom["who"]), F.lit("")), F.lit("相关主体"))
    moment = F.coalesce(F.nullif(text(atom["when"]), F.lit("")), F.nullif(text(atom["first_time"]), F.lit("")))
    moment = F.coalesce(F.concat(F.lit("在"), moment), F.lit(""))
    thing = F.coalesce(F.nullif(text(atom["what"]), F.lit("")), F.nullif(text(atom["answer_object"]), F.lit("")), F.lit("该术语"))
    lead = F.concat(F.lit("根据"), source, F.lit("，"))
    said = (
        F.when(kind == "A", F.concat(lead, subject, moment, F.lit("："), detail, F.lit("。")))
        .when(kind == "B", F.concat(lead, atom["answer_actor"], F.lit("可以作为该问题的确定主体"), F.when(detail != "", F.concat(F.lit("；相关规则为："), detail)).otherwise(""), F.lit("。")))
        .otherwise(F.concat(lead, thing, F.lit("的定义为："), detail, F.lit("。")))
    )
    return F.struct(said.alias("text"), atom["atom_id"].alias("atom_id"), source.alias("source"), atom["rule_type"].alias("rule_type"),
                    atom["answer_actor"].alias("answer_actor"), thing.alias("answer_object"))


def hit_rates(answered: DataFrame, by: list[str]) -> DataFrame:
    """Share of questions answered on the fast path per group."""
    return answered.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if(F.col("route") == "fast_path").alias("answered"),
    ).withColumn("hit_rate", F.col("answered") / F.col("questions"))


def slow_questions(answered: DataFrame) -> DataFrame:
    """Questions that go on to evidence recall."""
    return answered.filter(F.col("route") == "slow_path").select("query_id", "question", "query", "who")

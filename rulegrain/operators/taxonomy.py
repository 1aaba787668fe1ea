"""Business taxonomy: codes, weighted classification, scene matching, question routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import (
    category_core, has, multiline_items, phrase_terms, remove_space, scene_name_tokens, strip, text, to_string_list, words,
)
from rulegrain.operators.containment import find_terms, with_term_lists
from rulegrain.operators.scale import broadcast_if_small, carry_forward, ordered_distinct, split_repeated, top_rows
from rulegrain.session import cut_lineage

HAYSTACK_FIELDS = ["source_document", "what", "how", "where", "content_original"]


# ------------------------------------------------------------------ catalog
def code_prefix(section: Column) -> Column:
    return F.when(section == V.PRIMARY_SECTION, "BIZ").otherwise("BASE")


def taxonomy_modules(rows: DataFrame, prefix=code_prefix, with_unclassified: bool = True) -> DataFrame:
    """Ordered taxonomy rows (row_no, category, module, projects, remark) to coded modules.

    Rows whose category and module are the same 【title】 open a section.
    """
    filled = rows.select(
        "row_no", *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("category", "module", "projects", "remark")]
    ).filter(reduce(lambda a, b: a | b, [F.col(name) != "" for name in ("category", "module", "projects", "remark")]))
    header = F.startswith("category", F.lit("【")) & (F.col("category") == F.col("module"))
    marked = filled.withColumn("head", F.when(header, strip(F.translate("category", "【】", ""))))
    placed = carry_forward(marked, [], "row_no", "head", "section").filter(F.col("section").isNotNull() & F.col("head").isNull())
    entries = placed.select(
        "row_no", "section", strip("category").alias("category"), strip("module").alias("module"),
        multiline_items("projects").alias("projects"), strip("remark").alias("remark"),
    )

    def numbered(keys: list[str], name: str) -> DataFrame:
        first = entries.groupBy(*keys, name).agg(F.min("row_no").alias("_first"))
        return first.withColumn(f"{name}_index", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).drop("_first")

    coded = (
        entries.join(numbered(["section"], "category"), ["section", "category"])
        .join(numbered(["section", "category"], "module"), ["section", "category", "module"])
        .withColumn("code", F.format_string("%s-%02d-%02d", prefix(F.col("section")), "category_index", "module_index"))
        .withColumn("label_path", F.concat_ws(" > ", "section", "category", "module"))
    )
    if with_unclassified:
        blank = rows.sparkSession.range(1).select(
            F.lit(V.UNCLASSIFIED_NAME).alias("section"), F.lit(V.UNCLASSIFIED_NAME).alias("category"),
            F.lit(V.UNCLASSIFIED_NAME).alias("module"), F.lit((1 << 62)).cast("long").alias("row_no"), words([]).alias("projects"),
            F.lit(V.UNCLASSIFIED_REMARK).alias("remark"), F.lit(0).alias("category_index"), F.lit(0).alias("module_index"),
            F.lit(V.UNCLASSIFIED_CODE).alias("code"), F.lit(V.UNCLASSIFIED_PATH).alias("label_path"),
        )
        coded = coded.withColumn("row_no", F.col("row_no").cast("long")).unionByName(blank)
    phrases = F.concat(F.array("module", category_core("category")), "projects")
    return coded.withColumn("projects_text", F.array_join("projects", "；")).withColumn("terms", phrase_terms(phrases))


def taxonomy_scenes(modules: DataFrame) -> DataFrame:
    """One scene per project of a module."""
    return modules.select("*", F.posexplode("projects").alias("_at", "scene_name")).select(
        F.format_string("%s-SCENE-%02d", "code", F.col("_at") + 1).alias("scene_key"), "scene_name",
        scene_name_tokens("scene_name").alias("scene_terms"), F.col("code").alias("module_code"),
        "module", "category", "section", "label_path",
    )


def taxonomy_dimensions(modules: DataFrame) -> dict[str, DataFrame]:
    """Boards, categories and modules (D3)."""
    key = F.concat_ws("::", "section", "category")
    return {
        "boards": modules.select(F.col("section").alias("name")).distinct(),
        "categories": modules.select(key.alias("key"), F.col("category").alias("name"), "section").distinct(),
        "modules": modules.select(
            "code", F.col("module").alias("name"), "section", "category", key.alias("category_key"), "label_path",
            "projects_text", "remark",
        ),
    }


def taxonomy_metadata(modules: DataFrame, scenes: DataFrame, title: str = "") -> DataFrame:
    counts = modules.agg(F.count("*").alias("entry_count"))
    return counts.join(F.broadcast(scenes.agg(F.count("*").alias("scene_count")))).withColumn("title", F.lit(title))


# ------------------------------------------------------------------ scoring by contained terms
def containment_scores(texts: DataFrame, text_column: str, ids: list[str], evidence: DataFrame, targets: list[str]) -> DataFrame:
    """Sum of evidence weights per (ids, targets) over the needles a text contains.

    ``evidence`` has (needle, *targets, weight); equal needles of a target merge first, and every
    needle is searched once per text however many targets share it.
    """
    merged = evidence.filter(F.length("needle") > 0).groupBy("needle", *targets).agg(F.sum("weight").alias("weight"))
    found = find_terms(texts.select(*ids, text_column), text_column, merged, "needle", keep=ids)
    scored = found.withColumnRenamed("term", "needle").join(broadcast_if_small(merged), "needle")
    return scored.groupBy(*ids, *targets).agg(F.sum("weight").alias("score"))


def overlapping_values(values: DataFrame, needles: DataFrame) -> DataFrame:
    """(value, needle) pairs where either text contains the other; both inputs are distinct."""
    inside = find_terms(values.select(F.col("value"), F.col("value").alias("_text")), "_text", needles, "needle").select(
        "value", F.col("term").alias("needle")
    )
    around = find_terms(needles.select(F.col("needle"), F.col("needle").alias("_text")), "_text", values, "value").select(
        F.col("term").alias("value"), "needle"
    )
    return inside.union(around).distinct()


# ------------------------------------------------------------------ classification
def prepared_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms with parsed legacy lists; absent columns read as empty."""
    out = atoms
    for name in [*HAYSTACK_FIELDS, "who", "when", "rule_type", "article_reference"]:
        out = out.withColumn(name, text(name)) if name in atoms.columns else out.withColumn(name, F.lit(""))
    for name in ("business_categories", "related_scenarios"):
        if name not in atoms.columns:
            out = out.withColumn(name, words([]))
        elif not dict(atoms.dtypes)[name].startswith("array"):
            out = out.withColumn(name, to_string_list(name))
    return out.withColumn("atom_id", strip("atom_id"))


def heuristic_labels(atoms: DataFrame, modules: DataFrame, weights: dict[str, int] = V.CLASSIFIER_WEIGHTS) -> DataFrame:
    """Weighted containment classifier: (atom_id, label_codes, reason).

    The winner needs 12 points; the next two join it with at least max(24, winner - 4). Ties go to
    the module that stands first in the taxonomy.

    Atoms meet no modules. What an atom shows (terms of its text, legacy values, with repeats) is its evidence; equal evidence is scored
    once, and atoms take the labels of their evidence.
    """
    atoms = prepared_atoms(atoms).filter(F.col("atom_id") != "")
    real = modules.filter(F.col("code") != V.UNCLASSIFIED_CODE).withColumn("core", category_core("category"))
    w = {name: F.lit(value) for name, value in weights.items()}

    def item(kind: str, needle: Column, weight: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), needle.alias("needle"), weight.alias("weight"))

    def each(kind: str, needles: str, weight: Column) -> Column:
        return F.transform(needles, lambda needle: item(kind, needle, weight))

    def term(needle: Column) -> Column:
        return item("text", needle, F.when(F.length(needle) >= 4, w["long_term"]).otherwise(w["short_term"]))

    single = F.array(
        item("text", F.col("module"), w["module"]), item("text", F.col("core"), w["category"]),
        item("scenario", F.col("module"), w["scenario_module"]), item("scenario", F.col("core"), w["scenario_category"]),
        item("category", F.col("module"), w["legacy_module"]), item("category", F.col("core"), w["legacy_category"]),
    )
    many = [each("text", "projects", w["project"]), each("scenario", "projects", w["scenario_project"]), F.transform("terms", term)]
    rows = real.select("code", F.explode(F.concat(single, *many)).alias("e")).select("code", "e.*").filter(F.length("needle") > 0)

    haystack = F.concat(*HAYSTACK_FIELDS, F.array_join("business_categories", " "), F.array_join("related_scenarios", " "))
    def shown(kind: str, values: str) -> Column:
        return F.transform(values, lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    of_text = rows.filter(F.col("kind") == "text").groupBy("kind", F.col("needle").alias("value"), "code").agg(F.sum("weight").alias("weight"))
    listed = rows.filter(F.col("kind") != "text").groupBy("kind", "needle", "code").agg(F.sum("weight").alias("weight"))
    texts = with_term_lists(atoms.select("atom_id", haystack.alias("haystack"), "related_scenarios", "business_categories"), "haystack", of_text, "value")
    items = texts.select("atom_id", F.concat(shown("text", "terms"), shown("scenario", "related_scenarios"), shown("category", "business_categories")).alias("items"))
    seen = cut_lineage(items.groupBy("atom_id").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("evidence")))

    kinds = cut_lineage(seen.select("evidence").distinct().withColumn("kind_no", F.monotonically_increasing_id()))
    parts = kinds.select("kind_no", F.explode("evidence").alias("e")).select("kind_no", "e.*")
    values = parts.filter(F.col("kind") != "text").select("value").distinct()
    of_value = overlapping_values(values, listed.select("needle").distinct()).join(listed, "needle").groupBy("kind", "value", "code").agg(F.sum("weight").alias("weight"))
    weights_of = broadcast_if_small(cut_lineage(of_text.unionByName(of_value)))
    scores = parts.join(weights_of, ["kind", "value"]).groupBy("kind_no", "code").agg(F.sum("weight").alias("score"))
    order = broadcast_if_small(real.groupBy("code").agg(F.min("row_no").alias("row_no")))
    best = top_rows(scores.join(order, "code"), ["kind_no"], [F.desc("score"), F.col("row_no")], 3)
    winner = F.max("score").over(Window.partitionBy("kind_no"))
    chosen = best.withColumn("top", winner).filter(
        (F.col("top") >= 12) & ((F.col("rank") == 1) | (F.col("score") >= F.greatest(F.lit(24), F.col("top") - 4)))
    )
    codes = chosen.groupBy("kind_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda pair: pair["code"]).alias("label_codes"),
        F.max("top").alias("top"),
    )
    labels = cut_lineage(kinds.join(codes, "kind_no").select("evidence", "label_codes", "top"))
    matched = F.concat(F.lit("Heuristic fallback: matched taxonomy terms, top score="), F.col("top").cast("string"))
    return seen.join(broadcast_if_small(labels), "evidence", "left").select(
        "atom_id",
        F.coalesce("label_codes", words([V.UNCLASSIFIED_CODE])).alias("label_codes"),
        F.when(F.col("label_codes").isNotNull(), matched).otherwise("Heuristic fallback: no strong taxonomy match").alias("reason"),
    )


def normal_path(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(remove_space(value), "＞", ">"), "->", ">")


def resolve_labels(results: DataFrame, modules: DataFrame) -> DataFrame:
    """External results (atom_id, labels array, reason) to at most three known codes."""
    named = results.select("atom_id", F.posexplode("labels").alias("at", "value")).filter(F.col("value") != "")
    named = named.withColumn("code_key", F.upper(remove_space("value"))).withColumn("path_key", normal_path(F.col("value")))
    codes = broadcast_if_small(modules.select(F.col("code").alias("code_key"), "code").distinct())
    paths = broadcast_if_small(
        modules.groupBy(normal_path(F.col("label_path")).alias("path_key")).agg(F.max_by("code", "row_no").alias("path_code"))
    )
    known = named.join(codes, "code_key", "left").join(paths, "path_key", "left")
    known = known.withColumn("code", F.coalesce("code", "path_code")).filter(F.col("code").isNotNull())
    listed = ordered_distinct(known, ["atom_id"], "code", "at", 3, "label_codes")
    return results.select("atom_id", "reason").join(listed, "atom_id", "left").withColumn(
        "label_codes", F.coalesce("label_codes", words([V.UNCLASSIFIED_CODE]))
    )


def pending_atoms(atoms: DataFrame, done: DataFrame) -> DataFrame:
    """Atoms without a stored result."""
    return atoms.filter(strip("atom_id") != "").join(done.select("atom_id").distinct(), "atom_id", "left_anti")


def labeller_batches(atoms: DataFrame, size: int = 12) -> DataFrame:
    """Fixed projection for an external labeller, in batches."""
    from rulegrain.operators.scale import number_rows

    fields = ["atom_id", "source_document", "rule_type", "article_reference", "who", "what", "how", "where", "content_original"]
    prepared = prepared_atoms(atoms)
    out = number_rows(prepared.select(
        "row_no", *[strip(name).alias(name) for name in fields],
        F.col("business_categories").alias("legacy_business_categories"), F.col("related_scenarios").alias("legacy_related_scenarios"),
    ), ["row_no"], "_no")
    return out.withColumn("batch_no", F.floor((F.col("_no") - 1) / size) + 1).drop("_no", "row_no")


def combine_labels(heuristic: DataFrame, external: DataFrame | None) -> DataFrame:
    """External labels where usable, the heuristic ones elsewhere."""
    if external is None:
        return heuristic
    failed = (F.col("label_codes") == words([V.UNCLASSIFIED_CODE])) & F.contains("reason", F.lit("LLM"))
    usable = external.select("atom_id", F.coalesce("label_codes", words([])).alias("label_codes"), F.coalesce("reason", F.lit("")).alias("reason"))
    usable = usable.filter(~failed)
    return usable.unionByName(heuristic.join(usable.select("atom_id"), "atom_id", "left_anti"))


def with_label_columns(atoms: DataFrame, labels: DataFrame, modules: DataFrame) -> DataFrame:
    """Atoms with label codes, paths, sections, categories, modules and the reason."""
    catalog = broadcast_if_small(modules.groupBy("code").agg(
        F.max_by(F.struct("label_path", "section", "category", "module"), "row_no").alias("m")
    ))
    # labels of one atom in several rows make one list and a row per reason; equal lists are named once
    per_atom = labels.groupBy("atom_id").agg(F.collect_list(F.struct("label_codes", "reason")).alias("l")).select(
        "atom_id",
        F.sort_array(F.flatten(F.transform("l", lambda row: F.transform(
            F.coalesce(row["label_codes"], words([])), lambda code, at: F.struct(at.alias("at"), code.alias("code")))))).alias("placed"),
        F.transform("l", lambda row: row["reason"]).alias("reasons"),
    )
    lists = per_atom.select("placed").distinct()
    rows = lists.select("placed", F.explode("placed").alias("p")).select("placed", "p.at", "p.code").join(catalog, "code")
    gathered = rows.groupBy("placed").agg(F.sort_array(F.collect_list(F.struct("at", "code", "m"))).alias("l"))
    pick = lambda build: F.array_distinct(F.transform("l", build))
    columns = cut_lineage(gathered.select(
        "placed", pick(lambda item: item["code"]).alias("label_codes"),
        pick(lambda item: item["m"]["label_path"]).alias("label_paths"), pick(lambda item: item["m"]["section"]).alias("sections"),
        pick(lambda item: item["m"]["category"]).alias("categories"), pick(lambda item: item["m"]["module"]).alias("modules"),
    ))
    missing = {
        "label_codes": V.UNCLASSIFIED_CODE, "label_paths": V.UNCLASSIFIED_PATH, "sections": V.UNCLASSIFIED_NAME,
        "categories": V.UNCLASSIFIED_NAME, "modules": V.UNCLASSIFIED_NAME,
    }
    out = prepared_atoms(atoms).join(per_atom, "atom_id", "left").withColumn("classification_reason", F.explode_outer("reasons"))
    out = out.join(broadcast_if_small(columns), "placed", "left").drop("placed", "reasons")
    for name, value in missing.items():
        out = out.withColumn(name, F.coalesce(name, words([value])))
    return out.withColumn("classification_reason", F.coalesce("classification_reason", F.lit("无分类结果，已回退待分类")))


def classify(atoms: DataFrame, modules: DataFrame, external: DataFrame | None = None) -> DataFrame:
    return with_label_columns(atoms, combine_labels(heuristic_labels(atoms, modules), external), modules)


# ------------------------------------------------------------------ scene matching
def scene_matches(classified: DataFrame, scenes: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(atom_id, scene_key, module_code, score, matched_terms) with a score of at least 8.

    Scenes hang together per module, so an atom meets only the scenes of its labels and scores them
    inside the row; only matches leave it. Only the matches of atoms that have several rows (``repeated``, see
    :func:`split_repeated`) are merged by a shuffle, or all where a module names a scene twice.
    """
    by_module = scenes.groupBy("module_code").agg(
        F.sort_array(F.collect_list(F.struct("scene_key", "scene_name", "scene_terms"))).alias("scenes")
    )
    parts = F.array(*HAYSTACK_FIELDS, F.array_join("related_scenarios", " "))
    haystack = F.array_join(F.filter(parts, lambda part: part != ""), "\n")
    prepared = prepared_atoms(classified).filter(F.col("atom_id") != "").select("atom_id", haystack.alias("haystack"), "related_scenarios", "label_codes")
    by_module = broadcast_if_small(by_module)
    if scenes.groupBy("module_code", "scene_key").count().filter("count > 1").isEmpty():
        single, many = split_repeated(prepared, "atom_id", repeated=repeated)
    else:
        single, many = None, prepared

    def scored(scene: Column) -> Column:
        name = scene["scene_name"]
        tokens = F.filter(F.array_distinct(scene["scene_terms"]), lambda term: (term != name) & has(F.col("haystack"), term))
        legacy = F.filter("related_scenarios", lambda value: (F.length(name) > 0) & (F.contains(value, name) | F.contains(name, value)))
        named = F.when(has(F.col("haystack"), name), F.array(name)).otherwise(words([]))
        return F.struct(
            scene["scene_key"].alias("scene_key"),
            (F.size(named) * 20 + F.size(tokens) * 8 + F.size(legacy) * 12).alias("score"),
            F.array_distinct(F.concat(named, tokens, legacy)).alias("matched_terms"),
        )

    hits = F.filter(F.transform("scenes", scored), lambda match: match["score"] >= 8)

    def matched(atoms: DataFrame, codes: str | Column) -> DataFrame:
        met = atoms.withColumn("module_code", F.explode(codes)).join(by_module, "module_code")
        return met.select("atom_id", "module_code", F.explode(hits).alias("m")).select("atom_id", "m.scene_key", "module_code", "m.score", "m.matched_terms")

    # The same pair again (repeated atom rows) keeps its best score; equal scores merge their terms.
    merged = matched(many, "label_codes").groupBy("atom_id", "scene_key", "module_code").agg(
        F.max("score").alias("score"), F.sort_array(F.collect_set(F.struct("score", "matched_terms"))).alias("all"),
    )
    best = F.filter("all", lambda item: item["score"] == F.col("score"))
    terms = F.array_distinct(F.flatten(F.transform(best, lambda item: item["matched_terms"])))
    merged = merged.select("atom_id", "scene_key", "module_code", "score", terms.alias("matched_terms"))
    return merged if single is None else matched(single, F.array_distinct("label_codes")).unionByName(merged)


def scene_entity_counts(matches: DataFrame, links: DataFrame, alias: str) -> DataFrame:
    """Atoms per (scene, entity name)."""
    return matches.select("atom_id", "scene_key").join(links.select("atom_id", F.col("name").alias(alias)), "atom_id").groupBy(
        "scene_key", alias
    ).agg(F.count("*").alias("atom_count"))


# ------------------------------------------------------------------ question routing
def route_questions(questions: DataFrame, modules: DataFrame, scenes: DataFrame) -> DataFrame:
    """Matched scenes and modules of each question (query_id, question, query).

    Scores come from needle lookups: no question meets a scene it shares no text with.
    """
    modules = modules.withColumn("core", category_core("category"))
    lit = lambda value: F.lit(value).alias("weight")
    asked = reduce(DataFrame.union, [
        scenes.select(F.col("scene_name").alias("needle"), F.lit("scene").alias("kind"), F.col("scene_key").alias("key"), lit(24)),
        scenes.select(F.explode("scene_terms").alias("needle"), F.lit("scene"), "scene_key", lit(8)),
        modules.select("module", F.lit("module"), "code", lit(18)),
        modules.select("core", F.lit("module"), "code", lit(8)),
        modules.select(F.explode("projects"), F.lit("module"), "code", lit(16)),
    ])
    by_question = containment_scores(
        questions.select("query_id", strip("question").alias("asked")), "asked", ["query_id"], asked, ["kind", "key"]
    )
    queries = questions.select("query_id", strip("query").alias("value")).filter(F.col("value") != "")
    values = queries.select("value").distinct()
    both = scenes.select(F.col("scene_name").alias("needle"), F.lit("scene").alias("kind"), F.col("scene_key").alias("key"), lit(32)).union(
        modules.select("module", F.lit("module"), "code", lit(22))
    ).filter(F.col("needle") != "")
    near = overlapping_values(values, both.select("needle").distinct()).join(both, "needle")
    projects = modules.select("code", F.explode("projects").alias("needle"))
    inside = find_terms(projects.select("needle", F.col("needle").alias("_text")).distinct(), "_text", values, "value").select(
        F.col("term").alias("value"), "needle"
    ).join(projects, "needle").select("value", F.lit("module").alias("kind"), F.col("code").alias("key"), lit(14))
    by_query = near.select("value", "kind", "key", "weight").union(inside).groupBy("value", "kind", "key").agg(F.sum("weight").alias("score"))
    by_query = queries.join(by_query, "value").select("query_id", "kind", "key", "score")
    scores = by_question.unionByName(by_query).groupBy("query_id", "kind", "key").agg(F.sum("score").alias("score"))

    scene_info = broadcast_if_small(scenes.select(F.col("scene_key").alias("key"), "module_code", "scene_name"))
    scene_hits = scores.filter(F.col("kind") == "scene").join(scene_info, "key")
    best_scenes = top_rows(scene_hits, ["query_id"], [F.desc("score"), F.col("key")], 5)
    module_scores = scores.filter(F.col("kind") == "module").select("query_id", "key", "score").union(
        scene_hits.select("query_id", "module_code", "score")
    ).groupBy("query_id", "key").agg(F.sum("score").alias("score"))
    best_modules = top_rows(module_scores.filter(F.col("score") >= 18), ["query_id"], [F.desc("score"), F.col("key")], 5)
    picked = best_scenes.select("query_id", F.col("module_code").alias("code"), F.col("rank").alias("at")).union(
        best_modules.select("query_id", "key", F.col("rank") + 100)
    )
    module_list = ordered_distinct(picked, ["query_id"], "code", "at", None, "module_codes")
    listed = best_scenes.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "scene_name"))).alias("s"))
    scene_list = listed.select(
        "query_id", F.transform("s", lambda item: item["key"]).alias("scene_keys"),
        F.transform("s", lambda item: item["scene_name"]).alias("scene_names"),
    )
    out = questions.join(scene_list, "query_id", "left").join(module_list, "query_id", "left")
    for name in ("scene_keys", "scene_names", "module_codes"):
        out = out.withColumn(name, F.coalesce(name, words([])))
    return out

"""The property graph as two tables: build, patterns, health, comparison, export."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import has_any, strip, text, words
from rulegrain.operators.scale import broadcast_if_small, split_repeated, top_rows
from rulegrain.session import cut_lineage

NODE_TYPES = ["board", "category", "module", "scene", "atom", "actor", "object", "time_context"]
EDGE_TYPES = [
    "HAS_CATEGORY", "HAS_MODULE", "HAS_SCENE", "TAGGED_AS", "MATCHES_SCENE", "INVOLVES_ACTOR", "TARGETS_OBJECT",
    "HAS_TIME_CONTEXT", "SCENE_HAS_ACTOR", "SCENE_HAS_OBJECT", "SCENE_HAS_TIME",
]
# entity kind: node type, node id prefix, edge from atoms, edge from scenes
ENTITY_KINDS = {
    "actor": ("actor", "ACTOR", "INVOLVES_ACTOR", "SCENE_HAS_ACTOR"),
    "object": ("object", "OBJECT", "TARGETS_OBJECT", "SCENE_HAS_OBJECT"),
    "time": ("time_context", "TIME", "HAS_TIME_CONTEXT", "SCENE_HAS_TIME"),
}


def node_id(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws("::", F.lit(kind), *parts)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in the given order; merges map-side, so a key repeated everywhere is no burden."""
    rest = [name for name in rows.columns if name not in keys and name not in order]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [name for name in rows.columns if name not in keys and name not in order]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


# ------------------------------------------------------------------ build
def taxonomy_nodes(modules: DataFrame, scenes: DataFrame) -> DataFrame:
    board = modules.select(node_id("BOARD", "section").alias("id"), F.lit("board").alias("type"), F.col("section").alias("name"))
    category = modules.select(
        node_id("CATEGORY", "section", "category").alias("id"), F.lit("category").alias("type"), F.col("category").alias("name"), "section",
    )
    module = modules.select(
        node_id("MODULE", "code").alias("id"), F.lit("module").alias("type"), F.col("module").alias("name"), "code", "label_path",
        "projects_text", "remark", F.col("row_no").alias("seq"),
    )
    scene = scenes.select(
        node_id("SCENE", "scene_key").alias("id"), F.lit("scene").alias("type"), F.col("scene_name").alias("name"),
        F.col("module_code").alias("code"), "label_path",
    )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [module, board, category, scene])
    return latest(rows.withColumn("seq", F.coalesce("seq", F.lit(0))), ["id"], ["seq"])


def atom_nodes(atoms: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``atoms`` carries its term arrays (who_terms, who_terms_normalized, ...); only rows whose id may be ``repeated`` are shuffled."""
    keep = [name for name in (
        "source_document", "article_reference", "who", "who_terms", "who_terms_normalized", "when", "when_terms", "when_terms_normalized",
        "rule_type", "what", "what_terms", "what_terms_normalized", "how", "content_original", "is_ambiguous",
    ) if name in atoms.columns]
    rows = atoms.filter(strip("atom_id") != "").select("atom_id", *keep, F.col("row_no").alias("seq"))
    single, many = (
        part.select(node_id("ATOM", "atom_id").alias("id"), F.lit("atom").alias("type"), "atom_id", *keep, "seq")
        for part in split_repeated(rows, "atom_id", repeated=repeated))
    return single.drop("seq").unionByName(latest(many, ["id"], ["seq"]))


def lists_of_atoms(atoms: DataFrame, lists: list[str], repeated: DataFrame | None = None) -> DataFrame:
    """One row per atom id with the distinct members of its lists; only rows whose id may be ``repeated`` are shuffled."""
    single, many = split_repeated(atoms.select("atom_id", *lists), "atom_id", repeated=repeated)
    merged = many.groupBy("atom_id").agg(*[F.array_distinct(F.flatten(F.collect_list(name))).alias(name) for name in lists])
    return single.select("atom_id", *[F.array_distinct(name).alias(name) for name in lists]).unionByName(merged)


def entity_nodes(kind: str, links: DataFrame) -> DataFrame:
    """Nodes of one entity kind; the record of the last atom, by ``row_no`` where the links have it, stands for the name."""
    node_type, prefix, _, _ = ENTITY_KINDS[kind]
    order = [name for name in ("row_no", "atom_id") if name in links.columns]
    rows = links.select(
        node_id(prefix, "record.name").alias("id"), F.lit(node_type).alias("type"), "record.name", "record.normalized_name",
        "record.aliases", "record.matched_aliases", "record.source_categories", "record.is_normalized", *order,
    )
    return latest(rows, ["id"], order)


def node_parts(modules: DataFrame, scenes: DataFrame, atoms: DataFrame, links: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Nodes by type; ``taxonomy`` holds boards, categories, modules and scenes."""
    parts = {"taxonomy": taxonomy_nodes(modules, scenes), "atom": atom_nodes(atoms)}
    return {**parts, **{ENTITY_KINDS[kind][0]: entity_nodes(kind, rows) for kind, rows in links.items()}}


def together(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def build_nodes(modules: DataFrame, scenes: DataFrame, atoms: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    return together(node_parts(modules, scenes, atoms, links).values())


def _edge(rows: DataFrame, source: Column, target: Column, kind: str, **props: str) -> DataFrame:
    return rows.select(
        source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), *[F.col(value).alias(name) for name, value in props.items()],
    )


def taxonomy_edges(modules: DataFrame, scenes: DataFrame) -> dict[str, DataFrame]:
    board, category = node_id("BOARD", "section"), node_id("CATEGORY", "section", "category")
    module = node_id("MODULE", "code")
    return {
        "HAS_CATEGORY": _edge(modules, board, category, "HAS_CATEGORY").distinct(),
        "HAS_MODULE": _edge(modules, category, module, "HAS_MODULE").distinct(),
        "HAS_SCENE": _edge(scenes, node_id("MODULE", "module_code"), node_id("SCENE", "scene_key"), "HAS_SCENE").distinct(),
    }


def list_edges(listed: DataFrame) -> dict[str, DataFrame]:
    """Edges from atoms, read from one row per atom (:func:`lists_of_atoms`) with label_codes and a list of names per entity kind."""
    parts = {"TAGGED_AS": _edge(listed.select("atom_id", F.explode("label_codes").alias("code")), node_id("ATOM", "atom_id"), node_id("MODULE", "code"), "TAGGED_AS")}
    for kind, (_, prefix, from_atom, _) in ENTITY_KINDS.items():
        if kind in listed.columns:
            named = listed.select("atom_id", F.explode(kind).alias("name"))
            parts[from_atom] = _edge(named, node_id("ATOM", "atom_id"), node_id(prefix, "name"), from_atom)
    return parts


def match_edges(matches: DataFrame) -> DataFrame:
    return _edge(matches, node_id("ATOM", "atom_id"), node_id("SCENE", "scene_key"), "MATCHES_SCENE", score="score", matched_terms="matched_terms")


def scene_name_counts(listed: DataFrame, matches: DataFrame) -> DataFrame:
    """(scene_key, kind, name, atom_count): atoms of a scene that hold a name, for all entity kinds with one join by atom."""
    kinds = [kind for kind in ENTITY_KINDS if kind in listed.columns]
    met = matches.select("atom_id", "scene_key").join(listed.select("atom_id", *kinds), "atom_id")

    def tagged(kind: str) -> Column:
        return F.transform(F.coalesce(kind, words([])), lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    named = F.flatten(F.array(*map(tagged, kinds)))
    return met.select("scene_key", F.explode(named).alias("n")).groupBy("scene_key", "n.kind", "n.name").agg(F.count("*").alias("atom_count"))


def scene_name_edges(counts: DataFrame, kind: str) -> DataFrame:
    _, prefix, _, from_scene = ENTITY_KINDS[kind]
    return _edge(counts.filter(F.col("kind") == kind), node_id("SCENE", "scene_key"), node_id(prefix, "name"), from_scene, atom_count="atom_count")


def edge_parts(
    modules: DataFrame, scenes: DataFrame, atoms: DataFrame, links: dict[str, DataFrame], matches: DataFrame | None,
) -> dict[str, DataFrame]:
    """Edges by type; without ``matches`` those that come from them are left out."""
    listed = atoms.groupBy("atom_id").agg(F.array_distinct(F.flatten(F.collect_list("label_codes"))).alias("label_codes"))
    parts = {**taxonomy_edges(modules, scenes), "TAGGED_AS": list_edges(listed)["TAGGED_AS"]}
    if matches is not None:
        parts["MATCHES_SCENE"] = match_edges(matches)
    for kind, rows in links.items():
        _, prefix, from_atom, _ = ENTITY_KINDS[kind]
        # placed by atom once, for the distinct pairs and for the join with the matches
        named = rows.select("atom_id", F.col("record.name").alias("name")).repartition("atom_id").distinct()
        parts[from_atom] = _edge(named, node_id("ATOM", "atom_id"), node_id(prefix, "name"), from_atom)
        if matches is not None:
            counts = scene_name_counts(named.select("atom_id", F.array("name").alias(kind)), matches)
            parts[ENTITY_KINDS[kind][3]] = scene_name_edges(counts, kind)
    return parts


def build_edges(modules: DataFrame, scenes: DataFrame, atoms: DataFrame, links: dict[str, DataFrame], matches: DataFrame) -> DataFrame:
    """Edges keyed by (source, target, type) with nullable score, matched_terms, atom_count."""
    return together(edge_parts(modules, scenes, atoms, links, matches).values())


def rule_graph(rules: DataFrame, alignments: DataFrame, atoms: DataFrame) -> dict[str, DataFrame]:
    """Reference rules, documents, clause segments and atoms with their links (E3): first node wins, edges stay."""
    node = lambda rows, kind, key, **props: rows.select(
        F.lit(kind).alias("type"), key.alias("id"), *[F.col(value).alias(name) for name, value in props.items()]
    )
    doc = F.concat(F.lit("DOC:"), "document_name")
    linked = alignments.select("rule_id", "matched_segment_id", F.explode("aligned_atom_ids").alias("atom_id"))
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        node(rules, "ReferenceRule", F.col("rule_id"), name="expert_rule", check_type="check_type", entities="entities"),
        node(alignments, "Document", doc, name="document_name"),
        node(alignments, "ClauseSegment", F.col("matched_segment_id"), ref="matched_segment_ref", segment_type="matched_segment_type", text="matched_segment_text"),
        node(atoms, "LegalAtom", F.col("atom_id"), source_document="source_document", article_reference="article_reference", rule_type="rule_type", content_original="content_original"),
    ])
    edge = lambda rows, source, target, kind: rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    edges = reduce(DataFrame.unionByName, [
        edge(alignments, F.col("rule_id"), F.col("matched_segment_id"), "SUPPORTED_BY"),
        edge(alignments, F.col("matched_segment_id"), doc, "FROM_DOCUMENT"),
        edge(linked, F.col("rule_id"), F.col("atom_id"), "LINKS_TO_ATOM"),
        edge(linked, F.col("matched_segment_id"), F.col("atom_id"), "YIELDS_ATOM"),
    ])
    return {"nodes": nodes.dropDuplicates(["type", "id"]), "edges": edges}


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a uniqueness constraint."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


# ------------------------------------------------------------------ patterns
def _ends(edges: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    return edges.filter(F.col("type") == kind).select(F.col("source").alias(source), F.col("target").alias(target))


def boards(nodes: DataFrame, order: list[str] = (V.PRIMARY_SECTION, V.SECOND_SECTION)) -> DataFrame:
    place = F.lit(len(order))
    for at, name in enumerate(order):
        place = F.when(F.col("name") == name, at).otherwise(place)
    return nodes.filter(F.col("type") == "board").select("id", "name", place.alias("place")).orderBy("place", "name")


def category_overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules and distinct atoms per category; categories without any stay."""
    tagged = _ends(edges, "TAGGED_AS", "atom", "module")
    of_category = _ends(edges, "HAS_MODULE", "category", "module")
    atoms = of_category.join(tagged, "module").select("category", "atom").distinct().groupBy("category").agg(F.count("*").alias("atom_count"))
    modules = of_category.groupBy("category").agg(F.countDistinct("module").alias("module_count"))
    names = nodes.filter(F.col("type").isin("board", "category")).select("id", "name")
    return (
        _ends(edges, "HAS_CATEGORY", "board", "category").join(modules, "category", "left").join(atoms, "category", "left")
        .fillna(0, ["module_count", "atom_count"])
        .join(names.select(F.col("id").alias("category"), F.col("name").alias("category_name")), "category")
        .join(names.select(F.col("id").alias("board"), F.col("name").alias("board_name")), "board")
        .select("board_name", F.expr("substring(category, 11)").alias("category_key"), "category_name", "module_count", "atom_count")
    )


def module_scenes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Scenes of every module with their number of matched atoms (E5)."""
    hits = _ends(edges, "MATCHES_SCENE", "atom", "scene").groupBy("scene").agg(F.count("*").alias("precise_count"))
    return (
        _ends(edges, "HAS_SCENE", "module", "scene").join(hits, "scene", "left").fillna(0, ["precise_count"])
        .join(nodes.select(F.col("id").alias("scene"), F.col("name").alias("scene_name")), "scene")
    )


def path_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Board, category and module of every scene; modules without scenes stay."""
    named = lambda column: nodes.select(F.col("id").alias(column), F.col("name").alias(f"{column}_name"))
    path = _ends(edges, "HAS_MODULE", "category", "module").join(_ends(edges, "HAS_CATEGORY", "board", "category"), "category")
    path = path.join(_ends(edges, "HAS_SCENE", "module", "scene"), "module", "left")
    for column in ("board", "category", "module"):
        path = path.join(named(column), column)
    return path.join(named("scene"), "scene", "left")


def broad_atoms(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """First atoms of every module by id."""
    tagged = _ends(edges, "TAGGED_AS", "id", "module")
    picked = top_rows(tagged, ["module"], [F.col("id")], limit)
    return picked.join(nodes.filter(F.col("type") == "atom"), "id")


def actor_hit(wanted: Column, who: Column, *term_lists: Column) -> Column:
    """Wanted actors named in the text or listed among the terms."""
    in_lists = lambda term: reduce(lambda a, b: a | b, [F.array_contains(F.coalesce(terms, words([])), term) for terms in term_lists])
    return F.filter(wanted, lambda term: F.contains(F.coalesce(who, F.lit("")), term) | in_lists(term))


def precise_atoms(nodes: DataFrame, edges: DataFrame, limit: int, wanted: list[str] | None = None) -> DataFrame:
    """Best atoms of every scene, optionally only those naming an actor."""
    matches = edges.filter(F.col("type") == "MATCHES_SCENE").select(
        F.col("source").alias("id"), F.col("target").alias("scene"), "score", "matched_terms"
    )
    atoms = nodes.filter(F.col("type") == "atom")
    if wanted:
        hit = actor_hit(words(wanted), F.col("who"), F.col("who_terms_normalized"), F.col("who_terms"))
        atoms = atoms.withColumn("matched_who_terms", hit).filter(F.size("matched_who_terms") > 0)
        matches = matches.join(atoms.select("id"), "id", "left_semi")
    return top_rows(matches, ["scene"], [F.desc("score"), F.col("id")], limit).join(atoms.drop("score", "matched_terms"), "id")


def scene_counts(nodes: DataFrame, edges: DataFrame, wanted: list[str]) -> DataFrame:
    """Matched atoms of every scene, all and actor-filtered, in one pass."""
    hit = actor_hit(words(wanted), F.col("who"), F.col("who_terms_normalized"), F.col("who_terms"))
    atoms = nodes.filter(F.col("type") == "atom").select("id", (F.size(hit) > 0).alias("named"))
    return _ends(edges, "MATCHES_SCENE", "id", "scene").join(atoms, "id").groupBy("scene").agg(
        F.count("*").alias("precise_count"), F.count_if("named").alias("refined_count")
    )


def module_counts(edges: DataFrame) -> DataFrame:
    return _ends(edges, "TAGGED_AS", "atom", "module").groupBy("module").agg(F.count("*").alias("broad_count"))


def scene_actor_terms(nodes: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """Most frequent actor words per scene; normalised words first, then raw ones, then the text."""
    filled = lambda name: F.size(F.coalesce(name, words([]))) > 0
    terms = F.when(filled("who_terms_normalized"), F.col("who_terms_normalized")).when(filled("who_terms"), F.col("who_terms"))
    terms = terms.when(F.coalesce("who", F.lit("")) != "", F.array("who")).otherwise(words([]))
    atoms = nodes.filter(F.col("type") == "atom").select("id", F.explode(terms).alias("term"))
    counted = _ends(edges, "MATCHES_SCENE", "id", "scene").join(atoms, "id").groupBy("scene", "term").agg(F.count("*").alias("precise_count"))
    return top_rows(counted, ["scene"], [F.desc("precise_count"), F.col("term")], limit)


def scene_entity_links(nodes: DataFrame, edges: DataFrame, limit: int = 12, names: list[str] | None = None) -> DataFrame:
    """Top entities of every scene and kind."""
    kinds = {spec[3]: kind for kind, spec in ENTITY_KINDS.items()}
    rows = edges.filter(F.col("type").isin(list(kinds)))
    info = nodes.select(F.col("id").alias("target"), "name", "normalized_name", "aliases", "source_categories", "is_normalized")
    rows = rows.select(F.col("source").alias("scene"), "target", "type", "atom_count").join(info, "target")
    if names:
        rows = rows.filter(F.col("name").isin(names))
    kind = F.create_map(*[F.lit(part) for pair in kinds.items() for part in pair])
    rows = rows.withColumn("entity_type", F.element_at(kind, F.col("type"))).withColumn("normalized_name", F.coalesce("normalized_name", "name"))
    return top_rows(rows, ["scene", "entity_type"], [F.desc("atom_count"), F.col("name")], limit)


def keyword_atoms(atoms: DataFrame, keywords: list[str], fields: tuple[str, ...] = ("what", "how", "content_original")) -> DataFrame:
    """Atoms with a keyword in any of the fields."""
    tests = [has_any(text(name), keywords) for name in fields]
    return atoms.filter(reduce(lambda a, b: a | b, tests))


def neighbourhood(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 2) -> dict[str, DataFrame]:
    """Nodes and edges within a few hops of the start ids.

    Each hop is two equi joins of the edge table with the ids that the hop before has brought. What a hop brings is stored: the plan
    of a hop holds the edge table, not the plans of all hops before it.
    """
    known = frontier = cut_lineage(starts.select("id").distinct())
    for _ in range(hops):
        near = broadcast_if_small(frontier)
        out = edges.join(near.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        back = edges.join(near.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        frontier = cut_lineage(out.union(back).distinct().join(broadcast_if_small(known), "id", "left_anti"))
        known = known.union(frontier)
    reached = broadcast_if_small(known)
    inner = edges.join(reached.withColumnRenamed("id", "source"), "source", "left_semi").join(
        reached.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return {"nodes": nodes.join(reached, "id", "left_semi"), "edges": inner}


# ------------------------------------------------------------------ health
def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).filter(F.col("id") != "")
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def incidence(edges: DataFrame, ends: Sequence[str] = ("source", "target")) -> DataFrame:
    """(id, sources, targets): kinds of edges that start and end at an id, a row for each end that is met."""
    return together(edges.select(F.col(end).alias("id"), *[(F.array("type") if name == end else words([])).alias(f"{name}s") for name in ("source", "target")]) for end in ends)


def atom_incidence(listed: DataFrame) -> DataFrame:
    """The atoms' ends of :func:`list_edges`, a row per atom."""
    lists = {"label_codes": "TAGGED_AS", **{kind: spec[2] for kind, spec in ENTITY_KINDS.items() if kind in listed.columns}}
    found = F.array_compact(F.array(*[F.when(F.size(name) > 0, kind) for name, kind in lists.items()]))
    return listed.select(node_id("ATOM", "atom_id").alias("id"), found.alias("sources"), words([]).alias("targets")).filter(F.size("sources") > 0)


def graph_stats(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(kind, type, n) for nodes, edges and zero-degree nodes.

    ``ends`` is the :func:`incidence` of the edges where fewer rows are known to hold it. Ids meet once, as flags; only nodes without
    an edge are looked up again.
    """
    count = lambda rows, kind: rows.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    touched = (incidence(edges) if ends is None else ends).select("id", F.lit(True).alias("touched")).filter(F.col("id") != "")
    met = nodes.select("id", F.lit(False).alias("touched")).union(touched).groupBy("id").agg(F.max("touched").alias("touched"))
    lonely = broadcast_if_small(cut_lineage(met.filter(~F.col("touched")).select("id")))
    alone = nodes.join(lonely, nodes["id"].eqNullSafe(lonely["id"]), "left_semi")
    return count(nodes, "node").union(count(edges, "edge")).union(count(alone, "zero_degree"))


def coverage(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The eight coverage gaps: nodes of a kind with no edge of a kind (E16), as (gap, n). ``ends`` as in :func:`graph_stats`."""
    specs = [
        ("atoms_without_module", "atom", "source", ["TAGGED_AS"]), ("atoms_without_scene", "atom", "source", ["MATCHES_SCENE"]),
        ("atoms_without_module_and_scene", "atom", "source", ["TAGGED_AS", "MATCHES_SCENE"]),
        ("modules_without_atoms", "module", "target", ["TAGGED_AS"]), ("scenes_without_atoms", "scene", "target", ["MATCHES_SCENE"]),
        ("actors_without_atom", "actor", "target", ["INVOLVES_ACTOR"]), ("objects_without_atom", "object", "target", ["TARGETS_OBJECT"]),
        ("times_without_atom", "time_context", "target", ["HAS_TIME_CONTEXT"]),
    ]
    # a bit per end and edge kind and a count per node type, gathered by id in one aggregation of nodes and edge ends
    kinds = sorted({(end, kind) for _, _, end, edge_kinds in specs for kind in edge_kinds})
    types = sorted({node for _, node, _, _ in specs})
    none = F.lit(0).cast("long")
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(f"{end}s", kind), 1 << at).otherwise(0) for at, (end, kind) in enumerate(kinds)])
    met = (incidence(edges) if ends is None else ends).select("id", bits.cast("long").alias("bits"), *[none.alias(kind) for kind in types])
    held = nodes.select("id", none.alias("bits"), *[F.when(F.col("type") == kind, 1).otherwise(0).cast("long").alias(kind) for kind in types])
    flags = held.union(met.filter("bits <> 0 AND id IS NOT NULL")).groupBy("id").agg(F.bit_or("bits").alias("bits"), *[F.sum(kind).alias(kind) for kind in types])
    counts = [
        F.sum(F.when(F.col("bits").bitwiseAND(sum(1 << kinds.index((end, kind)) for kind in edge_kinds)) == 0, F.col(node)).otherwise(0)).alias(name)
        for name, node, end, edge_kinds in specs
    ]
    totals = [F.sum(kind).alias(f"{kind}_total") for kind in ("atom", "module", "scene")]
    return flags.agg(*counts, *totals).fillna(0)


def unhit(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str, limit: int) -> DataFrame:
    """First nodes of a kind that no edge of a kind reaches."""
    hit = _ends(edges, edge_type, "source", "id").select("id").distinct()
    return nodes.filter(F.col("type") == node_type).join(hit, "id", "left_anti").select("id", "name").orderBy("id").limit(limit)


def compare_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two statistics tables, absent rows counting as 0."""
    joined = left.withColumnRenamed("n", "left_n").join(right.withColumnRenamed("n", "right_n"), ["kind", "type"], "full_outer")
    filled = joined.fillna(0, ["left_n", "right_n"]).filter(~F.col("left_n").eqNullSafe(F.col("right_n")))
    return filled.withColumn("message", F.concat_ws(
        " ", F.initcap("kind"), F.lit("count mismatch for"), F.concat(F.lit("`"), "type", F.lit("`:")),
        F.concat(F.lit("left="), "left_n"), F.concat(F.lit("right="), "right_n"),
    ))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def health_report(
    gaps: DataFrame, zero_degree: DataFrame, mismatches: DataFrame | None = None, max_zero_degree: int = 0,
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """One row: ratios, failures, warnings and the status FAIL, WARN or PASS."""
    row = gaps.join(F.broadcast(zero_degree.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("zero_degree_total"))))
    if mismatches is None:
        row = row.withColumn("mismatches", F.lit(0).cast("long"))
    else:
        row = row.join(F.broadcast(mismatches.agg(F.count("*").alias("mismatches"))))
    failures = [
        F.when(F.col("mismatches") > 0, F.concat(F.col("mismatches").cast("string"), F.lit(" count mismatches"))),
        F.when(F.col("zero_degree_total") > max_zero_degree, F.concat(
            F.lit("Zero-degree node count "), F.col("zero_degree_total").cast("string"), F.lit(f" exceeds threshold {max_zero_degree}"))),
    ]
    for name, limit in (limits or {}).items():
        failures.append(F.when(F.col(name) > limit, F.concat(F.lit(f"{name}="), F.col(name).cast("string"), F.lit(f" exceeds threshold {limit}"))))
    percent = lambda gap, total: F.concat(F.format_number(ratio(F.col(gap), F.col(total)) * 100, 1), F.lit("%"))
    warning = lambda gap, total, head, tail: F.when(F.col(gap) > 0, F.concat(
        F.lit(head), F.col(gap).cast("string"), F.lit(" / "), F.col(total).cast("string"), F.lit(tail), percent(gap, total), F.lit(")")))
    warnings = F.array(
        warning("atoms_without_scene", "atom_total", "High atom-to-scene gap: ", " atoms have no scene match ("),
        warning("modules_without_atoms", "module_total", "Unhit modules remain: ", " modules have no atom evidence ("),
        warning("scenes_without_atoms", "scene_total", "Unhit scenes remain: ", " scenes have no atom evidence ("),
    )
    return (
        row.withColumn("failures", F.array_compact(F.array(*failures))).withColumn("warnings", F.array_compact(warnings))
        .withColumn("atoms_with_scene_ratio", ratio(F.col("atom_total") - F.col("atoms_without_scene"), F.col("atom_total")))
        .withColumn("modules_with_atoms_ratio", ratio(F.col("module_total") - F.col("modules_without_atoms"), F.col("module_total")))
        .withColumn("scenes_with_atoms_ratio", ratio(F.col("scene_total") - F.col("scenes_without_atoms"), F.col("scene_total")))
        .withColumn("status", F.when(F.size("failures") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS"))
    )


# ------------------------------------------------------------------ export
def cypher_value(df: DataFrame, name: str) -> Column:
    """A literal: JSON spells texts, numbers and lists in the way that the statement language reads them, with double quotes."""
    kind, column = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind.startswith("array"):
        return F.coalesce(F.to_json(column), F.lit("null"))
    if kind == "string":
        listed = F.to_json(F.array(column))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.coalesce(column.cast("string"), F.lit("null"))


def cypher_props(df: DataFrame, names: list[str]) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}: "), cypher_value(df, name)) for name in names])


NODE_LABELS = {
    "board": "BusinessBoard", "category": "BusinessCategory", "module": "BusinessModule", "scene": "BusinessScene",
    "atom": "BusinessAtom", "actor": "BusinessActor", "object": "BusinessObject", "time_context": "BusinessTimeContext",
}


def cypher_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One statement per node and edge."""
    label = lambda column: F.element_at(F.create_map(*[F.lit(part) for pair in NODE_LABELS.items() for part in pair]), column)
    props = [name for name in nodes.columns if name not in ("id", "type")]
    node_rows = nodes.select(F.concat(
        F.lit("MERGE (n:"), label(F.col("type")), F.lit(" {id: "), cypher_value(nodes, "id"), F.lit("}) SET n += {"),
        cypher_props(nodes, props), F.lit("};"),
    ).alias("statement"))
    edge_props = [name for name in edges.columns if name not in ("source", "target", "type")]
    edge_rows = edges.select(F.concat(
        F.lit("MATCH (a {id: "), cypher_value(edges, "source"), F.lit("}), (b {id: "), cypher_value(edges, "target"),
        F.lit("}) MERGE (a)-[r:"), F.col("type"), F.lit("]->(b) SET r += {"), cypher_props(edges, edge_props), F.lit("};"),
    ).alias("statement"))
    return node_rows.union(edge_rows)

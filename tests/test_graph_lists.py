"""The graph read from one row per atom equals the graph built from links; ids meet once for statistics."""

import pytest

from rulegrain.operators import entities as N, graph as G, taxonomy as X
from rulegrain.operators.scale import split_repeated
from rulegrain.plans import graph_queries as GQ

ATOMS = [("a", 1, ["m1", "m1"], ["x", "y"], ["o"], []), ("b", 2, ["m2"], ["x"], [], ["t"]), ("a", 3, ["m2"], ["y", "z"], ["o"], ["t"]), ("c", 4, [], [], [], [])]
SCHEMA = "atom_id string, row_no int, label_codes array<string>, actor array<string>, object array<string>, time array<string>"


@pytest.fixture
def parts(spark):
    atoms = spark.createDataFrame(ATOMS, SCHEMA)
    modules = spark.createDataFrame([("m1", "S", "C", "M1"), ("m2", "S", "C", "M2")], "code string, section string, category string, module string")
    scenes = spark.createDataFrame([("s1", "m1"), ("s2", "m2")], "scene_key string, module_code string")
    matches = spark.createDataFrame([("a", "s1", 9, ["k"]), ("b", "s1", 8, ["k"])], "atom_id string, scene_key string, score int, matched_terms array<string>")
    links = {kind: atoms.selectExpr("atom_id", f"explode({kind}) AS name").select("atom_id", N.plain_record(G.F.col("name"), [], False).alias("record")) for kind in G.ENTITY_KINDS}
    return atoms, matches, G.edge_parts(modules, scenes, atoms, links, matches)


def _rows(df):
    return sorted(map(str, (tuple(row) for row in df.select(sorted(df.columns)).collect())))


def test_lists_give_the_edges_of_links(spark, parts):
    atoms, matches, theirs = parts
    listed = G.lists_of_atoms(atoms, ["label_codes", *G.ENTITY_KINDS])
    assert listed.count() == 3
    counts = G.scene_name_counts(listed, matches)
    ours = {**G.list_edges(listed), **{spec[3]: G.scene_name_edges(counts, kind) for kind, spec in G.ENTITY_KINDS.items()}}
    assert len(ours) == 7
    for kind, rows in ours.items():
        assert _rows(rows) == _rows(theirs[kind]), kind


def test_known_ends_give_the_same_statistics(spark, parts):
    atoms, _, edges = parts
    every = G.together(edges.values())
    nodes = spark.createDataFrame(
        [("ATOM::a", "atom"), ("ATOM::b", "atom"), ("ATOM::c", "atom"), ("ATOM::c", "atom"), ("MODULE::m1", "module"), ("MODULE::m3", "module"), ("SCENE::s2", "scene"),
         ("ACTOR::x", "actor"), ("OBJECT::p", "object"), (None, "time_context"), ("", "board")], "id string, type string")
    listed = G.lists_of_atoms(atoms, ["label_codes", *G.ENTITY_KINDS])
    other = G.together([rows for kind, rows in edges.items() if kind not in GQ.OF_LISTS])
    ends = G.together([G.atom_incidence(listed), G.incidence(every, ["target"]), G.incidence(other, ["source"])])
    stats = G.graph_stats(nodes, every, ends)
    assert _rows(stats) == _rows(G.graph_stats(nodes, every))
    assert {(row["type"], row["n"]) for row in stats.filter("kind = 'zero_degree'").collect()} == {("atom", 2), ("module", 1), ("object", 1), ("time_context", 1), ("board", 1)}
    gaps = G.coverage(nodes, every, ends).first().asDict()
    assert gaps == G.coverage(nodes, every).first().asDict()
    assert gaps == {"atoms_without_module": 2, "atoms_without_scene": 2, "atoms_without_module_and_scene": 2, "modules_without_atoms": 1, "scenes_without_atoms": 1,
                    "actors_without_atom": 0, "objects_without_atom": 1, "times_without_atom": 1, "atom_total": 4, "module_total": 2, "scene_total": 1}
    assert G.coverage(nodes.limit(0), every.limit(0)).first()["atom_total"] == 0


def test_only_rows_whose_key_may_be_repeated_are_set_apart(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, v int")
    single, many = split_repeated(rows, "k")
    assert sorted(row["v"] for row in single.collect()) == [2, 4] and sorted(row["v"] for row in many.collect()) == [1, 3]


def test_matches_of_repeated_atoms_merge_and_of_others_do_not_travel(spark):
    scenes = spark.createDataFrame([("s1", "alpha", ["alpha"], "m"), ("s2", "beta", ["beta"], "m")], "scene_key string, scene_name string, scene_terms array<string>, module_code string")
    atoms = spark.createDataFrame([("a", "alpha", ["m", "m"]), ("b", "beta", ["m"]), ("b", "alpha beta", ["m"]), ("c", "none", ["m"])], "atom_id string, what string, label_codes array<string>")
    got = X.scene_matches(atoms, scenes)
    assert sorted((row["atom_id"], row["scene_key"], row["score"]) for row in got.collect()) == [("a", "s1", 20), ("b", "s1", 20), ("b", "s2", 20)]
    twice = X.scene_matches(atoms, scenes.union(scenes))
    assert _rows(twice) == _rows(got)
    alone = X.scene_matches(atoms.filter("atom_id = 'a'"), scenes)
    alone.collect()
    assert "hashpartitioning(atom_id" not in alone._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

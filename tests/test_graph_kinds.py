"""Graph queries read only the kinds they use; repeated atoms keep their last row."""

from rulegrain.operators import graph as G
from rulegrain.plans import corpus, graph_queries as GQ


def test_a_repeated_atom_keeps_its_last_row(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("a", "z", 3), (" ", "w", 4)], "atom_id string, who string, row_no int")
    got = {row["id"]: row["who"] for row in G.atom_nodes(rows).collect()}
    assert got == {"ATOM::a": "z", "ATOM::b": "y"}


def test_a_query_builds_only_the_kinds_it_uses(spark):
    folder = "/root/testdata/sf0.001"
    corpus._STORED.clear()
    GQ.category_overview(spark, folder).collect()
    built = {name for _, _, name in corpus._STORED}
    assert "graph TAGGED_AS" in built and not built & {"matches", "nodes", "edges", "graph INVOLVES_ACTOR", "graph atom"}

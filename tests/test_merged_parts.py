"""Merged tables: only the parts that are read are built, and an edge without either end is one row."""

from rulegrain.plans import store_queries
from rulegrain.sources.keyed_table import GraphStore


def test_edges_are_merged_without_nodes(spark):
    store = store_queries.merged_store(spark, "/root/testdata/sf0.001", ("edges",))
    assert store.nodes.read(spark) is None and store.edges.read(spark).count() > 0


def test_dangling_edges_are_single_rows(spark, tmp_path):
    store = GraphStore.at(str(tmp_path), ["seq"], 4)
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "id string, seq int")
    edges = spark.createDataFrame([("a", "b", "t", 1), ("a", "b", "t", None), ("a", "x", "t", 2), ("x", "y", "t", None), ("y", "b", "t", 1)], "source string, target string, type string, seq int")
    store.merge(nodes, edges)
    assert sorted(map(tuple, store.edges.read(spark).select("source", "target", "seq").collect())) == [("a", "b", 1), ("a", "x", 2), ("x", "y", None), ("y", "b", 1)]
    assert sorted((row["source"], row["target"]) for row in store.dangling(spark).collect()) == [("a", "x"), ("x", "y"), ("y", "b")]

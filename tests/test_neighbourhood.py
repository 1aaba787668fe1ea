"""Hops through the graph: right rows, and a plan that does not grow from hop to hop."""

from rulegrain.operators import graph as G


def _chain(spark, parts=5):
    rows = [(f"n{at}", f"n{at + 1}", "NEXT") for at in range(20)] + [("n0", "n0", "SELF"), ("hub", "n2", "TO"), ("far", "hub", "TO")]
    edges = spark.createDataFrame(rows, "source string, target string, type string")
    ids = sorted({end for row in rows for end in row[:2]} | {"alone"})
    return spark.createDataFrame([(name,) for name in ids], "id string"), G.together(edges.filter(f"hash(source, target) % {parts} in ({at}, {-at})") for at in range(parts))


def test_each_hop_goes_both_ways_and_nodes_without_edges_stay_out(spark):
    nodes, edges = _chain(spark)
    found = G.neighbourhood(nodes, edges, spark.createDataFrame([("n3",), ("alone",)], "id string"), hops=2)
    assert {row["id"] for row in found["nodes"].collect()} == {"n1", "n2", "n3", "n4", "n5", "hub", "alone"}
    assert {(row["source"], row["target"]) for row in found["edges"].collect()} == {("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("n4", "n5"), ("hub", "n2")}


def test_the_plan_holds_no_plans_of_earlier_hops(spark):
    nodes, edges = _chain(spark)
    plans = [G.neighbourhood(nodes, edges, nodes.filter("id = 'n0'"), hops)["nodes"]._jdf.queryExecution().analyzed().toString() for hops in (1, 4)]
    assert len(plans[1]) < 4 * len(plans[0])

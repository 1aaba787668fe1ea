"""A bundle's contents move once, unsorted before; lines travel without the rows that are built from them."""

from rulegrain.operators import artifacts as A
from rulegrain.operators.lineage import content_hash, unique_items
from rulegrain.plans import artifact_queries as Q


def test_the_first_entry_counts_and_nothing_is_sorted_before_the_shuffle(spark):
    items = spark.createDataFrame([(3, "a", "p", "x"), (1, "a", "p", "y"), (2, "b", "p", "z"), (None, "a", "q", "w"), (5, "a", "q", "v"), (6, None, "q", "u"), (7, None, "q", "t")],
                                  "item_no int, artifact_type string, artifact_path string, content string")
    got = unique_items(items)
    assert sorted(tuple(row) for row in got.select("item_no", "content").collect()) == [(1, "y"), (2, "z"), (5, "v"), (6, "u")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan[plan.index("Exchange hashpartitioning"):]


def test_a_path_may_be_registered_with_several_contents(spark):
    items = spark.createDataFrame([(1, "legal_atoms", "p", '[{"atom_id":"a"}]'), (2, "legal_atoms", "q", '[{"atom_id":"b"}]'), (3, "legal_atoms", "r", "[]")], "item_no int, artifact_type string, artifact_path string, content string")
    old = spark.createDataFrame([("p", "other"), ("p", '[{"atom_id":"a"}]'), ("p", '[{"atom_id":"a"}]'), ("q", "other")], "artifact_path string, content string")
    results = A.sync(items, "b", old.select("artifact_path", content_hash("content").alias("sha1"))).results
    assert {row["artifact_path"]: row["status"] for row in results.collect()} == {"p": "skipped", "q": "imported", "r": "imported"} and results.count() == 3


def test_lines_are_gathered_once_per_key(spark):
    lines = Q._lines(spark, "/root/testdata/sf0.001", "l_orderkey")
    assert [field.name for field in lines.schema["lines"].dataType.elementType] == [name for name in Q.LINE if name != "l_orderkey"]

"""Small cases of the third round of findings."""

from pyspark.sql import functions as F

from rulegrain.functions.text import once
from rulegrain.operators import entities as N, taxonomy as X
from rulegrain.operators.containment import with_term_lists
from rulegrain.plans import stream_queries
from rulegrain.session import cut_lineage
from rulegrain.sources import readers


def test_a_table_that_is_a_folder_is_streamed(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert stream_queries.documents_once(spark, str(tmp_path)).count() == 2


def test_a_stage_is_stored_as_columns(spark):
    stored = cut_lineage(spark.range(5).withColumn("wide", F.lit("x" * 100)))
    assert all(name.endswith(".parquet") for name in stored.inputFiles()) and stored.count() == 5


def test_equal_evidence_shares_its_labels_and_repeats_add_up(spark):
    modules = X.taxonomy_modules(spark.createDataFrame(
        [(1, "【S】", "【S】", "", ""), (2, "cat", "mod", "alpha", ""), (3, "cat", "other", "beta", "")],
        "row_no int, category string, module string, projects string, remark string"))
    atoms = spark.createDataFrame([("a", "alpha"), ("b", "alpha"), ("c", "beta"), ("c", "beta"), ("d", "none")], "atom_id string, what string")
    got = {row["atom_id"]: (row["label_codes"], row["reason"].rsplit("=", 1)[-1]) for row in X.heuristic_labels(atoms, modules).collect()}
    assert got["a"] == got["b"] and got["a"][0] != got["c"][0]
    assert int(got["c"][1]) == 2 * int(got["a"][1]) and got["d"][0] == ["UNCAT-00-00"]


def test_term_lists_agree(spark):
    texts = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (2, "xyz"), (3, None)], "id int, body string")
    terms = spark.createDataFrame([("abc",), ("d",), ("yz",), ("q",)], "term string")
    found = lambda strategy: sorted((row["id"], sorted(row["terms"] or [])) for row in with_term_lists(texts, "body", terms, "term", strategy=strategy).collect())
    assert found("auto") == found("grams") == [(1, ["abc", "d"]), (1, ["abc", "d"]), (2, ["yz"]), (3, [])]


def test_equal_texts_are_resolved_once(spark):
    rows = spark.range(50).select("id", F.lit("每月末").alias("when"))
    plan = N.time_records(rows, "id", "when", N.time_terms("when"), None)
    assert plan.count() == 50 and plan.select("record.name").distinct().count() == 1


def test_a_value_is_named_once(spark):
    row = spark.createDataFrame([("ab",), (None,)], "v string").select(once(F.upper("v"), lambda v: F.concat(v, v)).alias("v")).collect()
    assert [item["v"] for item in row] == ["ABAB", None]


def test_csv_files_are_passed_on_in_parts(spark, tmp_path):
    with open(f"{tmp_path}/a.csv", "w", encoding="gb18030") as file:
        file.write("k,v\n" + "".join(f'{n},"甲\n乙"\n' for n in range(25_000)))
    rows = readers.read_csv(spark, str(tmp_path), ["k", "v"])
    assert rows.count() == 25_000 and rows.select("v").distinct().collect()[0]["v"] == "甲\n乙"

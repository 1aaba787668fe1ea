"""Conflict detection shuffles a rule once for its groups; group sizes shuffle no whole rows."""

from pyspark.sql import functions as F

from rulegrain.operators import conflicts as C, quality as Q, scale


def _atoms(spark):
    rows = [("a1", 1, "甲", "办理业务事项", "不得超过10日", "doc1", "x"), ("a2", 2, "甲", "办理业务事项", "可以延至20日", "doc2", "y"), ("a3", 3, "甲", "办理业务事项", "可以延至20日", "doc2", "y"),
            ("a4", 4, "乙", "办理业务事项", "可以", "doc1", "x"), ("a5", 5, "丙", "办理业务事项", "3日", "doc1", ""), ("a6", 6, "丙", "办理业务事项", "5日", "doc1", "")]
    return spark.createDataFrame(rows, "atom_id string, row_no int, who string, what string, how string, source_document string, label_paths string").withColumn("rule_type", F.lit("OBL_MANDATORY"))


def test_groups_take_one_shuffle(spark):
    groups = C.scope_groups(C.comparable_atoms(_atoms(spark)))
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {row["first_pair"]["who"]: (row["rule_count"], row["forbid_count"], row["allow_count"], row["document_count"], row["label_count"], row["first_signatures"]) for row in groups.collect()}
    assert got == {"甲": (3, 1, 2, 2, 2, ["10日", "20日"]), "丙": (2, 0, 0, 1, 0, ["3日", "5日"])}


def test_known_sizes_are_not_counted_again(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    few = spark.range(2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    sizes = spark.createDataFrame([(0, 334), (1, 333)], "k long, count long")
    got = scale.spread_join(many, few, ["k"], ["id"], min_rows=300, sizes=sizes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(few, "k").collect()))


def test_group_sizes_move_no_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), "id")
    sized = Q.with_group_size(rows, "g")
    assert "Exchange hashpartitioning" not in sized._jdf.queryExecution().executedPlan().toString()
    assert {row["g"]: row["group_size"] for row in sized.collect()} == {"0": 334, "1": 333, "2": 333}

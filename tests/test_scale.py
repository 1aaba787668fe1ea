import random

from pyspark.sql import Window, functions as F

from rulegrain.operators import containment as K, recall as R, scale as S


def test_number_rows_is_the_global_order(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("k"))
    rows = sorted(S.number_rows(df, ["k"], "n").collect(), key=lambda row: row["k"])
    assert [row["n"] for row in rows] == list(range(1, 1001))


def test_blocked_windows_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(doc, at, rng.choice([None, None, "a", "b"])) for doc, n in (("hot", 500), ("cold", 7)) for at in range(1, n + 1)]
    df = spark.createDataFrame(rows, "doc string, at int, mark string")
    window = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = F.col("mark").isNotNull().cast("int")
    plain = df.select("doc", "at", F.sum(marked).over(window).alias("x"), F.last("mark", True).over(window).alias("y")).collect()
    summed = S.running_sum(df, ["doc"], "at", marked, "x", block_rows=16).select("doc", "at", "x")
    carried = S.carry_forward(df, ["doc"], "at", "mark", "y", block_rows=16).select("doc", "at", "y")
    assert sorted(summed.join(carried, ["doc", "at"]).collect(), key=str) == sorted(plain, key=str)


def test_spread_join_equals_plain_join(spark):
    many = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"))
    few = spark.range(11).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spread = S.spread_join(many, few, ["k"], ["id"], salts=5, min_rows=50)
    assert sorted(map(tuple, spread.select("id", "k", "v").collect())) == sorted(map(tuple, many.join(few, "k").select("id", "k", "v").collect()))


def test_containment_strategies_agree(spark):
    rng = random.Random(5)
    texts = [(at, "".join(rng.choice("甲乙丙ab ") for _ in range(rng.randint(0, 40)))) for at in range(60)] + [(99, None)]
    terms = sorted({"".join(rng.choice("甲乙丙ab ") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    t = spark.createDataFrame(texts, "id int, body string")
    w = spark.createDataFrame([(term,) for term in [*terms, ""]], "word string")
    expected = {(at, term) for at, body in texts for term in terms if body and term in body}
    for strategy in ("automaton", "grams"):
        got = K.find_terms(t, "body", w, "word", strategy).collect()
        assert len(got) == len(expected) and {(row["id"], row["term"]) for row in got} == expected


def test_capped_ranking_equals_the_greedy_pass(spark):
    rng = random.Random(9)
    rows = [(q, f"a{at}", float(rng.randint(0, 9)), f"d{rng.randint(0, 3)}") for q in ("x", "y") for at in range(60)]
    df = spark.createDataFrame(rows, "query_id string, atom_id string, score double, source_document string")
    expected = set()
    for q in ("x", "y"):
        taken, per_doc = 0, {}
        for _, atom, score, doc in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            if per_doc.get(doc, 0) < 3 and taken < 10:
                per_doc[doc] = per_doc.get(doc, 0) + 1
                taken += 1
                expected.add((q, atom, taken))
    atoms = df.select(F.concat("query_id", "atom_id").alias("atom_id"), "source_document")
    candidates = df.select("query_id", F.concat("query_id", "atom_id").alias("atom_id"), "score")
    got = R.rank_candidates(candidates, atoms, 10, per_document=3).collect()
    assert {(r["query_id"], r["atom_id"][1:], r["rank"]) for r in got} == expected


def test_expansion_scores_count_once_per_reason(spark):
    old = spark.createDataFrame([("q", "a", 10.0, ["r0"])], "query_id string, atom_id string, score double, reasons array<string>")
    new = spark.createDataFrame(
        [("q", "a", 5.0, "A-1", 1, "A"), ("q", "a", 7.0, "A-2", 2, "A"), ("q", "b", 3.0, "D-1", 5, "D")],
        "query_id string, atom_id string, score double, reason string, ord int, direction string")
    merged = {row["atom_id"]: (row["score"], row["reasons"]) for row in R.merge_expansions(old, new).collect()}
    # direction A: 12 points, two reasons -> 24 in the merged map; two reasons again -> 48
    assert merged == {"a": (58.0, ["r0", "A-1", "A-2"]), "b": (3.0, ["D-1"])}
    plain = {row["atom_id"]: row["score"] for row in R.merge_expansions(old, new, compat=False).collect()}
    assert plain == {"a": 22.0, "b": 3.0}

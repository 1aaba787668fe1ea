"""Equal questions are answered once; candidates of repeated atoms stay as many as they were."""

from pyspark.sql import functions as F

from rulegrain.operators import qa as Q


def test_equal_questions_are_built_once(spark):
    questions = spark.createDataFrame(
        [("1", "a", "", None), ("2", "a", "", None), ("3", "a", "", ""), ("4", "b", None, "w"), ("4", "b", None, "w")],
        "query_id string, question string, query string, who string")
    seen = []

    def build(told):
        seen.append(told.count())
        return told.select("query_id", "question", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))

    got = sorted(tuple(row) for row in Q.once_per_question(questions, build).select("query_id", "question", "n").collect())
    assert seen == [3]
    assert got == sorted((key, said, n) for key, said in [("1", "a"), ("2", "a"), ("3", "a"), ("4", "b"), ("4", "b")] for n in (1, 2))


def test_repeated_atoms_stay(spark):
    fields = [name for name in Q.ATOM_FIELDS]
    row = lambda key, how: ("x" if key == "x" else key, *["OBL_MANDATORY" if name == "rule_type" else how if name == "how" else name for name in fields[1:]])
    atoms = spark.createDataFrame([row("x", "one"), row("x", "one"), row("x", "two"), row("y", "one")], ", ".join(f"`{name}` string" for name in fields))
    link = lambda name: atoms.select("atom_id", F.lit(name).alias("name"), F.lit(None).cast("string").alias("normalized_name"))
    asked = spark.createDataFrame([("1", "A", ["who"], ["what"], []), ("2", "A", ["who"], ["what"], []), ("3", "A", [], ["what"], [])],
                                  "query_id string, question_type string, actors array<string>, objects array<string>, times array<string>")
    links = {"actor": link("who"), "object": link("what"), "time": link("when")}
    found = Q.retrieve(asked, atoms, links, atoms.select("atom_id").filter("atom_id = 'y'"))
    got = sorted((row["query_id"], row["rank"], row["atom_id"], row["match_count"]) for row in found.collect())
    assert got == [(key, rank, atom, 2) for key in "12" for rank, atom in enumerate("yxxx", 1)]
    assert sorted(row["how"] for row in found.filter("query_id = '1'").collect()) == ["one", "one", "one", "two"]

"""The recall loop scores kinds of atoms: the results are those of scoring every atom alone, and a kind sends only the atoms that can be ranked."""

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import recall as R, taxonomy as X

FIELDS = "atom_id string, source_document string, article_reference string, rule_type string, who string, what string, how string, `where` string, content_original string, is_ambiguous string, review_reason string, label_codes array<string>"


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a loop is many small jobs
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def tables(spark):
    modules = X.taxonomy_modules(spark.createDataFrame(
        [(1, "【票据】", "【票据】", "", ""), (2, "汇票", "银行汇票", "银行汇票提示付款\n银行汇票背书", ""), (3, "汇票", "商业汇票", "商业汇票承兑", "")],
        "row_no int, category string, module string, projects string, remark string"))
    scenes = X.taxonomy_scenes(modules)
    codes = [row["code"] for row in modules.orderBy("row_no").collect() if row["code"] != "UNCAT-00-00"]
    atoms = []
    for n in range(60):
        body = ["持票人提示付款应当提交银行汇票", "持票人未提交证件的，不得付款", "商业汇票承兑应当审核", "另有约定的除外，可以付款"][n % 4]
        # the number stands in a text, but no term asks for it; two documents, of which the first has more than eight atoms of a kind
        atoms.append((f"A{n:02}", f"办法{n % 2 if n > 40 else 0}", f"第{n % 3 + 1}条", ["PRC_FLOW", "PRO_FORBIDDEN", "DEF_SCOPE", "PER_AUTH"][n % 4], "持票人", body[:6], body, "", f"{body} {n}", "false", "NONE", [codes[n % 2]]))
    atoms.append(("A05", "办法1", "", "PER_AUTH", "出票人", "银行汇票", "可以背书", "", "银行汇票背书", "true", "", [codes[0]]))  # an id again, with another text
    atoms = spark.createDataFrame(atoms, FIELDS)
    matches = X.scene_matches(atoms, scenes)
    questions = spark.createDataFrame(
        [("q1", "持票人银行汇票提示付款需要提交哪些材料", "银行汇票", ["持票人"]), ("q2", "商业汇票承兑如何审核", "商业汇票", [])], "query_id string, question string, query string, who_terms array<string>")
    places = atoms.filter("article_reference <> ''").select(F.col("source_document").alias("doc"), F.col("article_reference").alias("ref")).distinct().withColumn("seg_no", F.substring("ref", 2, 1).cast("int"))
    return X.route_questions(questions, modules, scenes), atoms, modules, scenes, matches, places


def shown(result):
    pick = lambda name, *columns: sorted(map(str, result[name].select(*columns).collect()))
    return [pick("rounds", "*"), pick("report", "query_id", "stop_reason", "rule_id", "rounds", "initial_count", "final_count"),
            pick("evidence", "query_id", "rank", "atom_id", "source_document", "score", "reasons"), pick("candidates", "query_id", "atom_id", "score", "reasons")]


def test_kinds_give_the_results_of_atoms(spark, monkeypatch):
    given = tables(spark)
    kinds = shown(R.recall_loop(*given, max_rounds=2, initial_limit=6))
    monkeypatch.setattr(R, "with_kinds", lambda signed, terms, actors: signed.withColumn("kind", F.sha2("atom_id", 256)))
    assert kinds == shown(R.recall_loop(*given, max_rounds=2, initial_limit=6))
    assert len(kinds[3]) > 60


def test_a_kind_sends_the_atoms_that_can_be_ranked(spark):
    _, atoms, _, _, matches, _ = tables(spark)
    words = lambda *terms: spark.createDataFrame([(term,) for term in terms], "term string")
    signed = R.signed_atoms(atoms, matches)
    members = R.leading_members(signed, words("付款"), words("持票人"))
    places = {row["kind"]: row["n"] for row in members.groupBy("kind").agg(F.max("place").alias("n")).collect()}
    assert len(places) < 61 and max(places.values()) <= R.PER_DOCUMENT
    twice = members.filter("atom_id = 'A05'").collect()
    assert len(twice) == 2 and len({row["kind"] for row in twice}) == 1 and places[twice[0]["kind"]] == 1
    every = R.with_kinds(signed, words("付款", "7"), words("持票人"))
    assert every.select("kind").distinct().count() > len(places)  # another term tells more kinds apart

"""The recall loop on a small graph: scene profiles steer it, and a stopped loop resumes where it was."""

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import entities as N, profiles as P, recall as R, taxonomy as X

ATOMS = "atom_id string, row_no int, source_document string, article_reference string, rule_type string, who string, what string, how string, `where` string, content_original string, is_ambiguous string, review_reason string, business_categories string, related_scenarios string"


@pytest.fixture(scope="module")
def graph(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a loop is many small jobs
    yield tables(spark)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def tables(spark):
    rows = [(1, "【票据】", "【票据】", "", ""), (2, "汇票", "银行汇票", "银行汇票提示付款\n银行汇票背书", ""), (3, "汇票", "商业汇票", "商业汇票承兑", "")]
    modules = X.taxonomy_modules(spark.createDataFrame(rows, "row_no int, category string, module string, projects string, remark string"))
    scenes = X.taxonomy_scenes(modules)
    texts = ["持票人提示付款应当提交银行汇票和解讫通知", "持票人未提交证件的，不得付款", "银行汇票提示付款期限为一个月", "银行汇票是指出票银行签发的票据", "商业汇票承兑应当审核", "但书：另有约定的除外，可以付款"]
    atoms = [(f"A{n}", n, f"办法{n % 2}", f"第{n + 1}条" if n != 4 else "", ["PRC_FLOW", "PRO_FORBIDDEN", "VAL_THRESHOLD", "DEF_SCOPE", "OBL_MANDATORY", "PER_AUTH"][n], "持票人", body[:6], body, "", body,
              "false", "NONE", "", '["银行汇票"]') for n, body in enumerate(texts)]
    classified = X.classify(spark.createDataFrame(atoms, ATOMS), modules).withColumn("who_terms", N.actor_terms("who"))
    matches = X.scene_matches(classified, scenes)
    questions = spark.createDataFrame(
        [("q1", "持票人银行汇票提示付款需要提交哪些材料", "银行汇票", ["持票人"]), ("q2", "商业汇票承兑如何审核", "商业汇票", [])], "query_id string, question string, query string, who_terms array<string>")
    routed = X.route_questions(questions, modules, scenes)
    places = classified.filter("article_reference <> ''").select(F.col("source_document").alias("doc"), F.col("article_reference").alias("ref"), F.col("row_no").alias("seg_no"))
    return routed, classified, modules, scenes, matches, places


def shown(result):
    pick = lambda name, *columns: sorted(map(str, result[name].select(*columns).collect()))
    return {"rounds": pick("rounds", "query_id", "round", "rule_id", "decision", "new_count", "direction_count"),
            "report": pick("report", "query_id", "stop_reason", "final_decision", "rule_id", "rounds", "final_count", "scene_profile_id"),
            "evidence": pick("evidence", "query_id", "atom_id", "rank", F.round("score", 6).alias("score"))}


def test_profiles_steer_the_loop_and_a_stopped_one_resumes(spark, graph, tmp_path):
    def profile(name, scene, keyword, wanted):
        return {"profile_id": name, "scene_names": [scene], "question_keywords": [keyword], "min_evidence_count": 1, "min_direct_basis_count": 1,
                "derived_facts": [{"fact_id": "found", "source": "evidence", "mode": "keyword_any", "keywords": [wanted]}],
                "rule_specs": [{"rule_id": "r", "requires": {"fact": "found"}, "on_fail": {"dimension": wanted, "reason": "缺", "atom_label": wanted, "recall_directions": [("D", "补")]}}]}

    known = P.catalog(spark, [profile("draft", "银行汇票", "提示付款", "解讫通知"), profile("acceptance", "商业汇票", "承兑", "从未出现")])
    store = str(tmp_path / "loop")
    first = R.recall_loop(*graph, max_rounds=1, initial_limit=2, profiles=known, store=store)
    rows = {row["query_id"]: row for row in first["report"].collect()}
    assert (rows["q1"]["scene_profile_id"], rows["q2"]["scene_profile_id"]) == ("draft", "acceptance")
    assert rows["q1"]["rule_id"] in ("scene_profile_ready", "scene_profile_ready_with_conflict") and rows["q1"]["can_make_final"]
    assert rows["q2"]["rule_id"] == "scene_profile_missing_requirement" and [d["direction"] for d in rows["q2"]["directions"]] == ["D"]
    assert [(d["dimension"], d["reason"]) for d in rows["q2"]["missing_dimensions"]] == [("从未出现", "缺")]
    labels = {row["atom_id"]: row["missing_elements"] for row in first["analysis"].filter("query_id = 'q1'").collect()}
    assert labels and all(("解讫通知" in found) == (atom != "A0") for atom, found in labels.items())
    assert first["rounds"].count() == 2
    resumed = shown(R.recall_loop(*graph, max_rounds=2, initial_limit=2, profiles=known, store=store))
    assert resumed == shown(R.recall_loop(*graph, max_rounds=2, initial_limit=2, profiles=known))
    assert len(resumed["rounds"]) == 3  # q1 stopped in the first

"""Scene profiles, keyed tables and bundle imports on small, awkward inputs."""

import json

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import artifacts as A, profiles as P
from rulegrain.operators.lineage import content_hash
from rulegrain.sources.keyed_table import GraphStore, KeyedTable


def test_conditions_become_clauses():
    spec = {"all": [{"fact": "a"}, {"any": [{"fact": "b", "eq": False}, {"not": {"all": [{"fact": "c"}, {"fact": "d"}]}}]}]}
    assert P.normal_form(spec) == [
        [("a", "truthy", None, False), ("b", "eq", False, False)], [("a", "truthy", None, False), ("c", "truthy", None, True)],
        [("a", "truthy", None, False), ("d", "truthy", None, True)]]
    assert P.normal_form(None) == [[]] and P.normal_form(False) == [] and P.normal_form({"not": True}) == []


def test_profile_without_evidence_or_scene(spark):
    profile = {"profile_id": "p", "scene_names": ["汇票"], "question_keywords": ["付款"], "derived_facts": [{"fact_id": "seen", "source": "evidence", "mode": "keyword_any", "keywords": ["证件"]}],
               "rule_specs": [{"rule_id": "r1", "priority": 5, "requires": {"fact": "seen"}, "exception_if": None}, {"rule_id": "r2", "requires": {"fact": "seen", "falsy": True}}]}
    known = P.catalog(spark, [profile])
    questions = spark.createDataFrame(
        [("q1", "付款吗", ["银行汇票"], ["甲"]), ("q2", "付款吗", ["", " "], []), ("q3", "无关", ["汇票"], []), ("q4", "付款", ["汇"], [])],
        "query_id string, question string, scene_names array<string>, who_terms array<string>")
    evidence = spark.createDataFrame([("q1", "a1", None, None, "交验证件", None, None, None, "PRC_FLOW"), ("q1", "a2", "x", "y", "z", None, None, None, None)],
                                     "query_id string, atom_id string, who string, what string, how string, `where` string, content_original string, source_document string, rule_type string")
    found = {(r["query_id"], r["rule_id"]): (r["needed"], r["covered"], r["failed"]) for r in P.states(questions, evidence, known).collect()}
    # the exception of r1 is a condition that always holds, so r1 never fails
    assert found == {("q1", "r1"): (True, True, False), ("q1", "r2"): (True, False, True), ("q4", "r1"): (True, True, False), ("q4", "r2"): (True, True, False)}
    gaps = {r["atom_id"]: r["scene_labels"] for r in P.atom_gaps(questions, evidence, known).collect()}
    assert gaps == {"a1": [], "a2": []}  # r2 has no label to show
    with pytest.raises(ValueError):
        P.catalog(spark, [{**profile, "rule_specs": [{"rule_id": "r", "requires": {"fact": "unknown"}}]}])
    assert P.states(questions.filter("false"), evidence, known).isEmpty() and P.states(questions, evidence, P.catalog(spark, [])).isEmpty()


def test_two_loads_equal_one(spark, tmp_path):
    rows = [(f"n{n % 40}" if n % 11 else " ", n, f"v{n}", n % 3) for n in range(200)] + [(None, 999, "none", 0), ("hot", 1, "old", 1)] + [("hot", 300 + n, f"hot{n}", 2) for n in range(50)]
    frame = spark.createDataFrame(rows, "id string, seq int, name string, bucket int").drop("bucket")
    one, two = (KeyedTable(str(tmp_path / name), ("id",), ("seq",), 8) for name in ("one", "two"))
    assert two.read(spark) is None
    one.merge(frame)
    two.merge(frame.filter("seq < 120"))
    live = two._live(spark)
    assert two.merge(frame.filter("false")) == {"rewritten": 0, "kept": len(live)} and two._live(spark) == live
    done = two.merge(frame.filter("seq >= 120"))
    key = lambda table: sorted(map(tuple, table.read(spark).select("id", "seq", "name").collect()))
    assert key(one) == key(two) and len(key(one)) == 41
    few = two.merge(spark.createDataFrame([("n1", 5, "new", 7.5)], "id string, seq int, name string, weight double"))
    assert done["rewritten"] <= 8 and few == {"rewritten": 1, "kept": len(live) - 1}
    assert two.read(spark).filter("id = 'n1'").select("name", "weight").collect() == [("new", 7.5)]
    assert two.read(spark).filter("weight IS NOT NULL").count() == 1


def test_graph_store_tells_loose_edges(spark, tmp_path):
    store = GraphStore.at(str(tmp_path), ["seq"], 4)
    nodes = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "id string, type string, seq int")
    edges = spark.createDataFrame([("a", "b", "t", 1), ("a", "c", "t", 1), ("", "b", "t", 1)], "source string, target string, type string, seq int")
    store.merge(nodes, edges)
    assert store.dangling(spark).collect() == [("a", "c", "t")] and store.edges.read(spark).count() == 2


def test_bundle_items_fail_alone(spark, tmp_path):
    files = {"legal_atoms_v4_final.json": [{"atom_id": "A1", "label": 3, "business_taxonomy_label_codes": ["x"]}, {"atom_id": " ", "is_ambiguous": True}],
             "compliance_recall_a.json": {"question": "q", "rounds": [{"round": "1"}, {"round": "one"}]}, "compliance_recall_b.json": {"question": "q", "rounds": []},
             "sample_review_checklist_1.json": {"sheets": {}}, "sample_review_checklist_2.json": {"sheets": {"notes": [{"样本ID": "n"}], "atoms": [{"样本ID": "s", "x": "y"}]}}, "other.json": {}}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "legal_atoms_business_taxonomy.json").write_text('{"atoms": [', encoding="utf-8")
    items = A.discover(spark, str(tmp_path))
    assert items.count() == 5
    done = A.sync(items, "b1")
    results = {r["artifact_path"].split("/")[-1]: (r["status"], r["error"], r["row_count"]) for r in done.results.collect()}
    assert results == {
        "legal_atoms_v4_final.json": ("imported", None, 2), "compliance_recall_a.json": ("failed", "round is no number", 0), "compliance_recall_b.json": ("imported", None, 1),
        "legal_atoms_business_taxonomy.json": ("failed", "unreadable payload", 0), "sample_review_checklist_2.json": ("imported", None, 1)}
    assert [(r["atom_id"], r["is_ambiguous"], r["label_codes"]) for r in done.tables["legal_atoms"].orderBy("position").collect()] == [("A1", False, ["x"]), (None, True, None)]
    assert done.tables["sample_review_rows"].select("sheet_name", "sample_id").collect() == [("atoms", "s")]
    again = A.sync(items, "b2", A.registrations(done.results)).results
    assert {r["status"]: r["count"] for r in again.groupBy("status").count().collect()} == {"skipped": 3, "failed": 2}
    assert A.sync(items.filter("false"), "b3").results.isEmpty()
    assert content_hash(F.lit("x")) is not None


def test_repeated_rows_stay_apart_in_both_plans(spark):
    from rulegrain.operators.containment import find_terms

    texts = spark.createDataFrame([(1, "abcd abc"), (1, "abcd abc"), (None, "abc"), (None, "abc"), (2, None), (3, "")], "doc_id long, text string")
    terms = spark.createDataFrame([("abc",), ("abc",), ("d",), ("bcd a",), ("",), (None,), ("zz",)], "term string")
    plans = [sorted(map(str, find_terms(texts, "text", terms, "term", strategy).collect())) for strategy in ("automaton", "grams")]
    assert plans[0] == plans[1] and len(plans[0]) == 8


def test_documents_resolve_as_all_pairs_do(spark):
    from rulegrain.operators.align import resolve_documents

    names = ["《银行汇票管理办法》", "汇票", "aaa", "aa", "支付结算 办法", "无", "", "银行", None, "办法银行汇票管"]
    library = ["银行汇票管理办法", "支付结算办法", "aaab", "汇票业务", "票", ""]
    form = lambda name: "".join(x for x in name or "" if x not in "《》 ")
    wanted = set()
    for name in names:
        if name is None:
            continue
        a, best = form(name), []
        for other in library:
            b = form(other)
            score = (len(a) if a and a in b else 0) + (len(b) if b and b in a else 0) + len(set(a) & set(b))
            if score > 3:
                best.append((-score, other))
        if best:
            wanted.add((name, min(best)[1], -min(best)[0]))
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    found = resolve_documents(frame(names, "source_document"), frame(library, "document")).collect()
    assert {tuple(row) for row in found} == wanted


def test_csv_files_of_several_encodings(spark, tmp_path):
    from rulegrain.sources.readers import read_csv

    (tmp_path / "a.csv").write_bytes("规则,主体\r\n不得转让,\"甲,乙\r\n丙\"\r\n".encode("gb18030"))
    (tmp_path / "b.csv").write_bytes("﻿主体,规则,余\n丁,可以,x\n".encode())
    (tmp_path / "c.csv").write_bytes(b"")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path), ["规则", "主体"]).collect())) == [("不得转让", "甲,乙\r\n丙"), ("可以", "丁")]


def test_statements_spell_literals(spark):
    from rulegrain.operators.graph import cypher_statements

    nodes = spark.createDataFrame([("N'1", "actor", 'a "b"\n\\c', [1, 2], ["x'y", None], None)], "id string, type string, name string, ns array<int>, terms array<string>, score double")
    edges = spark.createDataFrame([("N'1", "M", "LINKS", None, True)], "source string, target string, type string, score int, flag boolean")
    assert sorted(row["statement"] for row in cypher_statements(nodes, edges).collect()) == [
        """MATCH (a {id: "N'1"}), (b {id: "M"}) MERGE (a)-[r:LINKS]->(b) SET r += {score: null, flag: true};""",
        r"""MERGE (n:BusinessActor {id: "N'1"}) SET n += {name: "a \"b\"\n\\c", ns: [1,2], terms: ["x'y",null], score: null};"""]

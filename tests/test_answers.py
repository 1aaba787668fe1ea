"""Guard behaviour of question answering on hand-made atoms; all questions run as one table."""

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import entities as N, qa as Q

ATOMS = [
    # id, rule type, article, who, what, when, how, content
    ("A-001", "OBL_MANDATORY", "第二十三条", "存款人", "基本存款账户", "经营地与注册地不在同一行政区域时", "应出具证明文件", "经营地与注册地不在同一行政区域的存款人，应出具证明文件。"),
    ("A-002", "PER_AUTH", "第八十七条", "出票人", "支票凭证", "", "可以签发支票", "出票人可以签发支票。"),
    ("A-003", "OBL_MANDATORY", "第二条", "银行", "许可证", "", "核发开户许可证", "银行负责核发开户许可证。"),
    ("A-004", "DEF_SCOPE", "第三条", "本法", "票据凭证", "", "本法所称票据凭证是指汇票本票和支票凭证", "本法所称票据凭证是指汇票、本票和支票凭证。"),
    ("A-005", "OBL_MANDATORY", "第九条", "持票人", "银行汇票", "", "应当提交汇票和解讫通知", "持票人应当提交银行汇票和解讫通知。"),
]
QUESTIONS = [
    ("scope", "存款人开立基本存款账户需要出具哪些证明文件", ""), ("precise", "出票人签发空头支票凭证可以吗", ""), ("who", "谁负责核发许可证", ""),
    ("definition", "票据凭证是指什么", ""), ("several", "是否可以、如何办理许可证", ""), ("material", "持票人使用银行汇票应当提交什么", ""), ("plain", "持票人使用银行汇票应当怎么做", ""),
    ("nothing", "应当怎么做", ""), ("condition", "什么情况下办理许可证", ""),
]


@pytest.fixture(scope="module")
def results(spark):
    atoms = spark.createDataFrame(ATOMS, "atom_id string, rule_type string, article_reference string, who string, what string, `when` string, how string, content_original string")
    atoms = atoms.withColumn("source_document", F.lit("结算账户管理办法")).withColumn("is_ambiguous", F.lit("false"))
    link = lambda name: atoms.filter(F.col(name) != "").select("atom_id", F.col(name).alias("name"), F.col(name).alias("normalized_name"))
    pairs = spark.createDataFrame([("主体别称", "储户", "存款人"), ("账户简称", "基本户", "基本存款账户")], "category string, alias string, canonical string")
    terms = lambda name: atoms.select(F.col(name).alias("term")).distinct()
    known = Q.Dictionaries(terms("who"), N.alias_index(pairs, ["主体别称"]), N.alias_index(pairs, ["账户简称"]), terms("what"))
    questions = spark.createDataFrame([(*row, "") for row in QUESTIONS], "query_id string, question string, query string, who string")
    answered = Q.answer_questions(questions, atoms, {"actor": link("who"), "object": link("what"), "time": link("when")}, atoms.limit(0), known)
    return {row["query_id"]: row for row in answered.collect()}


def test_fail_reasons(results):
    assert {key: row["fail_reason"] for key, row in results.items()} == {
        "scope": "unmatched_condition_scope", "precise": "intent_mismatch", "who": None, "definition": None, "several": "complex_multi_intent",
        "material": "intent_mismatch", "plain": None, "nothing": "insufficient_entities", "condition": "unsupported_question_type"}


def test_rejections_keep_their_evidence(results):
    assert results["scope"]["evidence_ids"] == ["A-001"] and results["precise"]["evidence_ids"] == ["A-002"]
    assert results["scope"]["route"] == "slow_path" and results["who"]["route"] == "fast_path"


def test_answer_texts(results):
    assert results["plain"]["answers"][0]["text"] == "根据结算账户管理办法·第九条，持票人：应当提交汇票和解讫通知。"
    assert results["who"]["answers"][0]["text"] == "根据结算账户管理办法·第二条，银行可以作为该问题的确定主体；相关规则为：银行负责核发开户许可证。"
    assert results["definition"]["answers"][0]["text"] == "根据结算账户管理办法·第三条，票据凭证的定义为：本法所称票据凭证是指汇票本票和支票凭证。"

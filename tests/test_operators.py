from pyspark.sql import functions as F

from rulegrain.operators import conflicts as C, entities as N, graph as G, instruments as I, quality as Q, segment as S, taxonomy as X

ATOM = "atom_id string, row_no int, source_document string, article_reference string, rule_type string, who string, what string, how string, content_original string"


def test_conflicts(spark):
    rows = [
        ("A1", 1, "d1", "", "PRO_FORBIDDEN", "甲公司", "开立账户业务", "不得3个", "x"), ("A2", 2, "d2", "", "PER_AUTH", "甲公司", "开立账户业务", "可以5个", "x"),
        ("A3", 3, "d2", "", "DEF_SCOPE", "甲公司", "开立账户业务", "可以7个", "x"), ("A4", 4, "d1", "", "PER_AUTH", "乙", "三字符", "可以", ""),
        ("A5", 5, "d1", "", "PRO_FORBIDDEN", "乙", "三字符", "不得", ""), ("A6", 6, "d1", "", "VAL_THRESHOLD", "丙", "现金支取限额", "二十万元", ""),
        ("A7", 7, "d1", "", "VAL_THRESHOLD", "丙", "现金支取限额", "200000元", ""),
    ]
    found = C.detect_conflicts(spark.createDataFrame(rows, ATOM))
    groups = [tuple(row)[:8] for row in found["groups"].collect()]
    assert groups == [
        ("CF-0002", "阈值口径不一致", "中", "甲公司", "开立账户业务", 2, 2, 0), ("CF-0003", "阈值口径不一致", "中", "丙", "现金支取限额", 2, 1, 0),
        ("CF-0001", "禁止/允许并存", "高", "甲公司", "开立账户业务", 2, 2, 0)]
    assert tuple(found["summary"].first()) == (3, 1, 2, 4)
    assert [(row["conflict_id"], row["atom_id"]) for row in found["details"].collect()] == [
        ("CF-0001", "A2"), ("CF-0001", "A1"), ("CF-0002", "A2"), ("CF-0002", "A1"), ("CF-0003", "A6"), ("CF-0003", "A7")]


def test_chunks_and_segments(spark):
    body = "x" * 1200 + "\n第一条 a\n" + "y" * 301 + "\n第二条 b\nz"
    chunks = S.chunk_documents(spark.createDataFrame([("d", body)], "k string, b string"), "k", "b").orderBy("chunk_index").collect()
    assert [len(row["content_original"]) for row in chunks] == [0, 1200, 307, 7]
    lines = ["前言", "第一条 甲", "乙", "第二章 总", "丙", "第二条 丁", "附二 x", "一、戊", "己"]
    table = spark.createDataFrame([("d", at + 1, line) for at, line in enumerate(lines)], "k string, line_no int, line string")
    articles = S.article_segments(table, "k").filter("type = 'article_block'").orderBy("seg_ord").collect()
    assert [(row["ref"], row["text"]) for row in articles] == [("第一条", "第一条 甲\n乙"), ("第二条", "第二条 丁\n附二 x\n一、戊\n己")]
    legal = S.legal_segments(table, "k").orderBy("seg_ord").collect()
    assert [(row["ref"], row["text"]) for row in legal] == [
        ("第一条", "第一条 甲\n乙"), ("第二条", "第二条 丁"), ("附二", "附二 x"), ("附二-一", "一、戊\n己")]


def test_alias_index_drops_ambiguous_aliases(spark):
    pairs = spark.createDataFrame(
        [("主体别称", "储户", "存款人"), ("主体别称", "客户", "存款人"), ("主体别称", "客户", "持票人"), ("▶分组", "x", "y"), ("机构简称", "人 行", "中国人民银行")],
        "category string, alias string, canonical string")
    index = N.alias_index(pairs, ["机构简称", "主体别称"])
    assert "客户" not in {row["term"] for row in index.aliases.collect()}
    rows = spark.createDataFrame([("1", "储户、客户"), ("2", "人行"), ("3", "")], "id string, who string")
    got = N.actor_records(rows, "id", "who", N.without_whole(N.actor_terms("who"), "who"), index).orderBy("id", "order").collect()
    assert [(row["id"], row["record"]["name"], row["record"]["is_normalized"]) for row in got] == [
        ("1", "存款人", True), ("1", "客户", False), ("2", "中国人民银行", True)]


def test_time_records(spark):
    rows = spark.createDataFrame([("1", "在银行开立存款账户前"), ("2", "提示付款期限内，10日内"), ("3", "未指定"), ("4", "每月末")], "id string, w string")
    got = N.time_records(rows, "id", "w", N.without_whole(N.time_terms("w"), "w"), None).collect()
    names = {key: [row["record"]["name"] for row in got if row["id"] == key] for key in "1234"}
    assert names == {"1": ["开立账户前"], "2": ["10日内"], "3": [], "4": ["每月末"]}


def test_classifier_and_scenes(spark):
    rows = [(1, "【业务管理类】", "【业务管理类】", "", ""), (2, "一、账户管理", "账户开立", "个人账户开立\n单位账户开立", ""), (3, "一、账户管理", "账户变更", "账户名称变更", ""),
            (4, "", "", "", ""), (5, "【基础管理类】", "【基础管理类】", "", ""), (6, "一、档案", "档案保管", "凭证保管", "")]
    modules = X.taxonomy_modules(spark.createDataFrame(rows, "row_no int, category string, module string, projects string, remark string"))
    codes = {row["module"]: row["code"] for row in modules.collect()}
    assert codes == {"账户开立": "BIZ-01-01", "账户变更": "BIZ-01-02", "档案保管": "BASE-01-01", "待分类": "UNCAT-00-00"}
    atoms = spark.createDataFrame(
        [("A1", 1, "d", "个人账户开立", "应当审核"), ("A2", 2, "d", "天气", "晴"), ("A3", 3, "d", "凭证保管", "保管")],
        "atom_id string, row_no int, source_document string, what string, how string")
    classified = X.classify(atoms, modules)
    labels = {row["atom_id"]: row["label_codes"] for row in classified.collect()}
    assert labels == {"A1": ["BIZ-01-01"], "A2": ["UNCAT-00-00"], "A3": ["BASE-01-01"]}
    matches = X.scene_matches(classified, X.taxonomy_scenes(modules)).collect()
    assert {(row["atom_id"], row["scene_key"], row["score"]) for row in matches} == {("A1", "BIZ-01-01-SCENE-01", 20), ("A3", "BASE-01-01-SCENE-01", 20)}


def test_instrument_checks(spark):
    schema = "payload_id string, issue_date string, core_date string, issue_date_chinese string, amount_numeric string, amount_upper string, signatures array<string>"
    rows = [("demo", "2026-03-01", "2026-03-08", "零叁月零壹日", "￥1680.32", "人民币壹仟陆佰捌拾元零叁角贰分", ["财务专用章", "法人章"]),
            ("empty", None, None, None, None, None, None), ("late", "2026-03-01", "2026-03-12", "三月一日", "12", None, ["公章"])]
    checks = I.payload_checks(spark.createDataFrame(rows, schema))
    status = {}
    for row in checks.collect():
        status.setdefault(row["payload_id"], {})[row["sequence"]] = row["status"]
    assert set(status["demo"].values()) == {"PASS"}
    assert status["empty"] == {1: "SKIP", 2: "SKIP", 3: "SKIP", 4: "SKIP", 5: "FAIL", 6: "SKIP", 7: "SKIP"}
    assert status["late"] == {1: "FAIL", 2: "FAIL", 3: "FAIL", 4: "FAIL", 5: "PASS", 6: "SKIP", 7: "FAIL"}
    assert {row["payload_id"]: row["overall_status"] for row in I.payload_summary(checks).collect()} == {"demo": "PASS", "empty": "FAIL", "late": "FAIL"}


def test_sample_size():
    assert [Q.sample_size(*args) for args in ((0, 5), (10, 5, 3), (1000, 5, 3, 20), (2, 50, 3))] == [0, 3, 20, 2]


def test_new_atoms_are_classified_once(spark, tmp_path):
    from rulegrain.streaming.incremental import classified, classify_new_atoms, read_stream

    modules = X.taxonomy_modules(spark.createDataFrame(
        [(1, "【业务管理类】", "【业务管理类】", "", ""), (2, "一、账户", "账户开立", "个人账户开立", "")], "row_no int, category string, module string, projects string, remark string"))
    schema = "atom_id string, row_no int, what string"
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for ids in (["A1", "A2"], ["A2", "A3"]):
        spark.createDataFrame([(name, 1, "个人账户开立") for name in ids], schema).coalesce(1).write.mode("append").parquet(source)
        classify_new_atoms(read_stream(spark, source, schema), modules, out, state).awaitTermination()
    assert sorted(row["atom_id"] for row in classified(spark, out).select("atom_id").collect()) == ["A1", "A2", "A3"]


def test_group_sizes_keep_null_groups(spark):
    rows = spark.createDataFrame([("A1", "x"), ("A2", None), ("A3", None), ("A4", "x"), ("A5", "")], "atom_id string, rule_type string")
    sized = {row["atom_id"]: row["group_size"] for row in Q.with_group_size(rows, "rule_type").collect()}
    assert sized == {"A1": 2, "A2": 2, "A3": 2, "A4": 2, "A5": 1}


def test_last_row_names_an_entity(spark):
    atoms = spark.createDataFrame([("O9", 1), ("O10", 2)], "atom_id string, row_no int")
    links = atoms.select("*", N.plain_record(F.lit("银行"), [], False).alias("record")).withColumn(
        "record", F.col("record").withField("normalized_name", F.col("atom_id")))
    assert [row["normalized_name"] for row in G.entity_nodes("actor", links).collect()] == ["O10"]
    assert [row["normalized_name"] for row in G.entity_nodes("actor", links.drop("row_no")).collect()] == ["O9"]


def test_keywords_past_the_preview_count(spark):
    from rulegrain.functions import vocab as V
    from rulegrain.operators import recall as R

    term = V.MATERIAL_TERMS[0]
    fields = "query_id long, atom_id string, position int, who string, what string, how string, where string, content_original string, source_document string, article_reference string, is_ambiguous string, score double"
    rows = [(1, "far", 1, "", "", "", "", "x" * 300 + term, "d", "1", "false", 1.0), (1, "none", 2, "", "", "", "", "x" * 300, "d", "1", "false", 1.0)]
    routed = spark.createDataFrame([(1, term, [])], "query_id long, question string, who_terms array<string>")
    lacks = {row["atom_id"]: row["missing_elements"] for row in R.atom_analysis(spark.createDataFrame(rows, fields), routed).collect()}
    assert "材料或签章要求" not in lacks["far"] and "材料或签章要求" in lacks["none"]

"""Seven checks of a payment instrument, run over a table of payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.numbers import capital_amount, capital_date_forms, numeric_amount, parse_date
from rulegrain.functions.text import comparison_form, half_width, has_any, non_blank, strip, text, words


def _result(status: str | Column, reason: str | Column) -> Column:
    lit = lambda value: F.lit(value) if isinstance(value, str) else value
    return F.struct(lit(status).alias("status"), lit(reason).alias("reason"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else F.coalesce(part.cast("string"), F.lit("None")) for part in parts])


def plain_number(value: Column) -> Column:
    """Decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def date_forms(day: Column) -> Column:
    """Accepted capital spellings of a date's month and day: a place in a literal list of 12 times 31, no join and no search."""
    forms: dict[int, list[str]] = {}
    for month, number, spelling in capital_date_forms():
        forms.setdefault((month - 1) * 31 + number - 1, []).append(spelling)
    listed = F.array(*[words(forms.get(at, [])) for at in range(12 * 31)])
    return F.get(listed, (F.month(day) - 1) * 31 + F.dayofmonth(day) - 1)


def payload_checks(payloads: DataFrame, max_days: int = 10) -> DataFrame:
    """One row per payload and rule: status PASS, FAIL or SKIP with the reason.

    ``payloads`` has payload_id, issue_date, core_date, issue_date_chinese, amount_numeric,
    amount_upper and signatures (array or delimited text). No shuffle is needed.
    """
    if dict(payloads.dtypes)["signatures"] == "string":
        signatures = F.when(F.col("signatures") != "", non_blank(F.split("signatures", "[，,；;|/]")))
    else:
        signatures = non_blank(F.col("signatures"))
    ready = (
        payloads.withColumn("issued", parse_date("issue_date")).withColumn("cored", parse_date("core_date"))
        .withColumn("spelled", strip("issue_date_chinese")).withColumn("amount_text", strip("amount_numeric"))
        .withColumn("amount", numeric_amount("amount_numeric")).withColumn("upper_text", strip("amount_upper"))
        .withColumn("upper", capital_amount("amount_upper")).withColumn("seals", signatures)
        .withColumn("spelled_norm", comparison_form("issue_date_chinese"))
        .withColumn("forms", date_forms(F.col("issued")))
    )
    days = F.abs(F.datediff("cored", "issued"))
    within = F.when(F.col("issued").isNull() | F.col("cored").isNull(), _result("SKIP", "缺少 issue_date 或 core_date。")).otherwise(
        _result(F.when(days <= max_days, "PASS").otherwise("FAIL"), _say("日期差 ", days, " 天。")))
    listed = F.concat(F.lit("['"), F.array_join("forms", "', '"), F.lit("']"))
    spelled_ok = F.exists("forms", lambda form: F.contains(F.col("spelled_norm"), form))
    spelled = F.when(F.col("issued").isNull() | (F.col("spelled") == ""), _result("SKIP", "缺少 issue_date 或 issue_date_chinese。")).when(
        spelled_ok, _result("PASS", "出票日期中文大写通过。")).otherwise(_result("FAIL", _say("不符合规则，期望形式之一：", listed, "。")))
    has_symbol = F.startswith(half_width("amount_text"), F.lit("¥"))
    symbol = F.when(F.col("amount_text") == "", _result("SKIP", "缺少 amount_numeric。")).when(
        has_symbol, _result("PASS", "小写金额包含人民币符号。")).otherwise(_result("FAIL", "缺少人民币符号￥。"))
    # A missing capital amount is not blank here: it compares unequal and fails.
    given_upper = F.col("amount_upper").isNull() | (F.col("upper_text") != "")
    equal = F.when(F.col("amount").isNull() | ~given_upper, _result("SKIP", "缺少 amount_numeric 或 amount_upper。")).when(
        F.col("upper").eqNullSafe(F.col("amount")), _result("PASS", "大小写金额一致。")).otherwise(
        _result("FAIL", _say("小写=", plain_number(F.col("amount")), "，大写解析=", plain_number(F.col("upper")), "。")))
    required = F.when(F.col("amount_text") != "", _result("PASS", "金额字段已填写。")).otherwise(_result("FAIL", "金额为空。"))
    body = strip(F.regexp_replace(half_width("upper_text"), "人民币", ""))
    closed = F.endswith(body, F.lit("整")) | F.endswith(body, F.lit("正"))
    form = (
        F.when(F.col("upper_text") == "", _result("SKIP", "缺少 amount_upper。"))
        .when(~F.col("upper_text").rlike(V.UPPER_AMOUNT_CHARACTERS), _result("FAIL", "包含非法字符。"))
        .when(~has_any(body, ["角", "分"]) & ~closed, _result("FAIL", "金额到元为止时，元后应写整/正。"))
        .when(has_any(body, ["分"]) & closed, _result("FAIL", "有分时，后面不应再写整/正。"))
        .when(F.col("upper").isNull(), _result("FAIL", "无法解析大写金额。"))
        .when(F.col("amount").isNotNull() & (F.col("upper") != F.col("amount")), _result("FAIL", _say(
            "大写解析值 ", plain_number(F.col("upper")), " 与小写金额 ", plain_number(F.col("amount")), " 不一致。")))
        .otherwise(_result("PASS", "大写金额格式通过。"))
    )
    any_of = lambda seals: F.exists("seals", lambda seal: has_any(seal, seals))
    finance, personal = any_of(V.FINANCE_SEALS), any_of(V.PERSONAL_SEALS)
    sealed = (
        F.when(F.col("seals").isNull(), _result("SKIP", "缺少 signatures。"))
        .when(finance & personal, _result("PASS", "签章组合满足要求。"))
        .when(~finance & ~personal, _result("FAIL", "同时缺少单位章与个人/法人签章。"))
        .when(~finance, _result("FAIL", "缺少财务专用章/公章。"))
        .otherwise(_result("FAIL", "缺少个人章/法人章/授权签章。"))
    )
    checks = [within, spelled, symbol, equal, required, form, sealed]
    rows = F.array(*[
        F.struct(F.lit(number).alias("sequence"), F.lit(name).alias("check_type"), check.alias("r"))
        for (number, name), check in zip(V.CHECK_TYPES, checks)
    ])
    return ready.select("payload_id", F.explode(rows).alias("c")).select(
        "payload_id", "c.sequence", F.format_string("REF-%03d", "c.sequence").alias("rule_id"), "c.check_type", "c.r.status", "c.r.reason"
    )


def payload_summary(checks: DataFrame) -> DataFrame:
    """Counts per payload and the overall status: FAIL before PASS before SKIP."""
    counts = checks.groupBy("payload_id").agg(
        *[F.count_if(F.col("status") == status).alias(status.lower()) for status in ("PASS", "FAIL", "SKIP")]
    )
    overall = F.when(F.col("fail") > 0, "FAIL").when(F.col("pass") > 0, "PASS").otherwise("SKIP")
    return counts.withColumn("overall_status", overall)


def run_rows(checks: DataFrame, summary: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """A check run as append-only tables: runs and their results."""
    keyed = lambda rows: rows.withColumn("run_id", F.concat_ws(":", F.lit(run_id), "payload_id"))
    return {"compliance_runs": keyed(summary), "run_results": keyed(checks)}

"""Chinese numbers, amounts and dates as folds over the characters of a column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import col, half_width, once, strip, text


def _lookup(table: dict[str, int]) -> Column:
    """A literal map from character to value."""
    pairs = [part for key, value in table.items() for part in (F.lit(key), F.lit(value).cast("long"))]
    return F.create_map(*pairs)


def _state(total: Column, section: Column, number: Column) -> Column:
    return F.struct(total.alias("total"), section.alias("section"), number.alias("number"))


def _zero() -> Column:
    return F.lit(0).cast("long")


def chinese_integer(value: str | Column, compat: bool = True) -> Column:
    """Everyday Chinese number to a long.

    ``compat`` keeps the known reading of 二十万 as 210000: a unit directly before 万 leaves no
    digit behind, and that missing digit is still counted as one.
    """
    body = col(value)
    digits, units = _lookup(V.CHINESE_DIGITS), _lookup(V.CHINESE_UNITS)
    characters = F.filter(F.split(body, ""), lambda ch: ch != "")
    plain = F.aggregate(
        characters, _zero(), lambda acc, ch: acc * F.lit(10) + F.coalesce(F.element_at(digits, ch), _zero())
    )

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = F.element_at(digits, ch), F.element_at(units, ch)
        implied = F.greatest(acc["number"], F.lit(1).cast("long"))
        before_myriad = implied if compat else F.when(acc["section"] > 0, acc["number"]).otherwise(implied)
        return (
            F.when(digit.isNotNull(), _state(acc["total"], acc["section"], digit))
            .when(unit.isNotNull(), _state(acc["total"], acc["section"] + implied * unit, _zero()))
            .otherwise(_state(acc["total"] + (acc["section"] + before_myriad) * F.lit(10000), _zero(), _zero()))
        )

    folded = F.aggregate(
        characters, _state(_zero(), _zero(), _zero()), step, lambda acc: acc["total"] + acc["section"] + acc["number"]
    )
    only_digits = body.rlike("^[" + "".join(V.CHINESE_DIGITS) + "]+$")
    return F.when(only_digits, plain).otherwise(folded)


def capital_integer(value: str | Column) -> Column:
    """Capital (banking) Chinese number to a long; unknown characters are skipped."""
    digits, units, sections = _lookup(V.CAPITAL_DIGITS), _lookup(V.CAPITAL_UNITS), _lookup(V.CAPITAL_SECTIONS)

    def step(acc: Column, ch: Column) -> Column:
        digit, unit, section = F.element_at(digits, ch), F.element_at(units, ch), F.element_at(sections, ch)
        implied = F.when(acc["number"] == 0, F.lit(1).cast("long")).otherwise(acc["number"])
        closed = (acc["section"] + acc["number"]) * section
        return (
            F.when(digit.isNotNull(), _state(acc["total"], acc["section"], digit))
            .when(unit.isNotNull(), _state(acc["total"], acc["section"] + implied * unit, _zero()))
            .when(section.isNotNull(), _state(acc["total"] + closed, _zero(), _zero()))
            .otherwise(acc)
        )

    characters = F.filter(F.split(text(value), ""), lambda ch: ch != "")
    return F.aggregate(
        characters, _state(_zero(), _zero(), _zero()), step, lambda acc: acc["total"] + acc["section"] + acc["number"]
    )


def numeric_signatures(value: str | Column, units: str = V.NUMERIC_UNITS, compat: bool = True) -> Column:
    """Distinct "number + unit" readings, Arabic ones first, in order of appearance."""
    body = text(value)
    arabic = F.regexp_extract_all(body, F.lit(rf"(\d+(?:\.\d+)?)\s*({units})"), F.lit(0))
    chinese = F.regexp_extract_all(body, F.lit(rf"([零〇一二两三四五六七八九十百千万]+)\s*({units})"), F.lit(0))
    number = r"^[零〇一二两三四五六七八九十百千万]+"
    arabic = F.transform(arabic, lambda token: F.regexp_replace(token, r"\s+", ""))
    chinese = F.transform(
        chinese,
        lambda token: F.concat(
            chinese_integer(F.regexp_extract(token, number, 0), compat).cast("string"),
            F.regexp_replace(F.regexp_replace(token, number, ""), r"\s+", ""),
        ),
    )
    return F.array_distinct(F.concat(arabic, chinese))


def numeric_amount(value: str | Column) -> Column:
    """Amount text such as ￥1,680.32 as decimal(20,2); null when it is not a number."""
    body = strip(F.regexp_replace(half_width(value), r"[¥,，]", ""))
    return once(body, lambda body: F.when(body.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), body).cast("decimal(20,2)"))


def capital_amount(value: str | Column) -> Column:
    """Capital Chinese amount as decimal(20,2); null for blank text."""
    digit = "([零壹贰貳叁肆伍陆陸柒捌玖])"
    values = _lookup(V.CAPITAL_DIGITS)

    def cents_of(body: Column) -> Column:
        whole = F.substring_index(body, "元", 1)
        rest = F.when(F.contains(body, F.lit("元")), F.regexp_replace(body, "^[^元]*元", "")).otherwise("")

        def part(rest: Column, unit: str) -> Column:
            return once(F.regexp_extract(rest, digit + unit, 1), lambda found: F.when(found != "", F.element_at(values, found)).otherwise(_zero()))

        return capital_integer(whole) * F.lit(100) + once(rest, lambda rest: part(rest, "角") * F.lit(10) + part(rest, "分"))

    body = strip(F.translate(F.regexp_replace(half_width(value), "人民币", ""), "圆圓整正", "元元"))
    return once(body, lambda body: F.when(body != "", (cents_of(body).cast("decimal(22,0)") / F.lit(100)).cast("decimal(20,2)")))


def parse_date(value: str | Column) -> Column:
    """Date in one of the four accepted layouts, null otherwise."""
    layouts = [
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
        (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
        (r"^\d{8}$", "yyyyMMdd"),
    ]
    return once(strip(half_width(value)), lambda body: F.coalesce(*[F.when(body.rlike(shape), F.try_to_date(body, layout)) for shape, layout in layouts]))


def capital_date_forms() -> list[tuple[int, int, str]]:
    """(month, day, accepted capital spelling) for every calendar month and day."""
    digit = {index: ch for index, ch in enumerate("零壹贰叁肆伍陆柒捌玖") if index}

    def tens(number: int) -> str:
        lead, rest = divmod(number, 10)
        return digit[lead] + "拾" + (digit[rest] if rest else "")

    months = {month: [f"零{digit[month]}月"] + ([f"{digit[month]}月"] if month > 2 else []) for month in range(1, 10)}
    months.update({month: [tens(month) + "月", "零" + tens(month) + "月"] for month in (10, 11, 12)})
    days = {day: [f"零{digit[day]}日"] for day in range(1, 10)}
    days.update({day: [tens(day) + "日"] + (["零" + tens(day) + "日"] if day < 20 else []) for day in range(10, 32)})
    return [
        (month, day, month_text + day_text)
        for month, month_texts in months.items()
        for day, day_texts in days.items()
        for month_text in month_texts
        for day_text in day_texts
    ]

"""Text columns: cleaning, normal forms, list parsing, keyword predicates.

All helpers take and return Columns, so Catalyst keeps them inside the surrounding stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from rulegrain.functions import vocab as V

# Whitespace as Python's str.strip sees it; translate and btrim take it as a character set.
SPACES = " \t\n\r\x0b\x0c" + "".join(
    map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
SPACE = "[" + SPACES + "]"
CONTROLS = "".join(map(chr, (*range(0, 9), 0x0B, 0x0C, *range(0x0E, 0x20))))

FULL_WIDTH = "".join(chr(code) for code in range(0xFF01, 0xFF5F)) + "\u3000\uffe5\uffe1\uffe0"
HALF_WIDTH = "".join(chr(code) for code in range(0x21, 0x7F)) + " \u00a5\u00a3\u00a2"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is computed once however often ``build`` names it, also where Spark does not share common parts."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def text(value: str | Column) -> Column:
    """The column as a string with null read as the empty string."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def strip(value: str | Column) -> Column:
    return F.btrim(text(value), F.lit(SPACES))


def clean_text(value: str | Column) -> Column:
    """Control characters removed, ends trimmed."""
    return strip(F.translate(text(value), CONTROLS, ""))


def collapse_space(value: str | Column) -> Column:
    """Runs of whitespace become one blank; the word "nan" counts as empty."""
    squeezed = strip(F.regexp_replace(text(value), f"{SPACE}+", " "))
    return F.regexp_replace(squeezed, "^(?i:nan)$", "")


def remove_space(value: str | Column) -> Column:
    return F.translate(text(value), SPACES, "")


def lookup_key(value: str | Column) -> Column:
    return remove_space(collapse_space(value))


def half_width(value: str | Column) -> Column:
    """Full-width forms to ASCII: the part of NFKC that regulation text uses."""
    return F.translate(text(value), FULL_WIDTH, HALF_WIDTH)


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Exact NFKC, for text where :func:`half_width` is not enough."""
    return values.fillna("").str.normalize("NFKC")


def comparison_form(value: str | Column) -> Column:
    """Normal form for overlap scores: width, O/0, two OCR slips, no blanks, no punctuation."""
    out = F.translate(half_width(value), "Oo", "00")
    for wrong, right in V.OCR_FIXES:
        out = F.regexp_replace(out, wrong, right)
    return F.translate(remove_space(out), V.NORM_PUNCTUATION, "")


def scope_text(value: str | Column) -> Column:
    """Text with control characters, blanks and punctuation removed, as used in scope keys."""
    return F.translate(text(value), CONTROLS + SPACES + V.SCOPE_PUNCTUATION, "")


def document_name_form(value: str | Column) -> Column:
    return F.translate(remove_space(half_width(value)), V.DOC_NAME_PUNCTUATION, "")


def has(value: str | Column, needle: str | Column) -> Column:
    """Containment that is false for an empty needle."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return (F.length(needle) > 0) & F.contains(col(value), needle)


def any_word_pattern(values: Iterable[str]) -> str:
    """A regular expression that finds any of the words; all characters are literal."""
    return "|".join(re.sub(r"([^\w\s]|_)", r"\\\1", value) for value in values if value)


def has_any(value: str | Column, words: Iterable[str]) -> Column:
    """True when any of a short, fixed word list occurs in the text: one scan for the whole list."""
    pattern = any_word_pattern(words)
    return F.rlike(col(value), F.lit(pattern)) if pattern else F.lit(False)


def has_all(value: str | Column, words: Iterable[str]) -> Column:
    tests = [F.contains(col(value), F.lit(word)) for word in words if word]
    return reduce(lambda left, right: left & right, tests) if tests else F.lit(True)


def ends_with_any(value: str | Column, endings: Iterable[str]) -> Column:
    return reduce(lambda left, right: left | right, [F.endswith(col(value), F.lit(end)) for end in endings])


def starts_with_any(value: str | Column, starts: Iterable[str]) -> Column:
    return reduce(lambda left, right: left | right, [F.startswith(col(value), F.lit(start)) for start in starts])


def words(values: Iterable[str]) -> Column:
    """A literal array<string>; empty lists keep their type."""
    values = list(values)
    return F.array(*[F.lit(value) for value in values]) if values else F.array().cast("array<string>")


def words_in(value: str | Column, vocabulary: Iterable[str]) -> Column:
    """The members of a fixed list that occur in the text, in list order."""
    haystack = col(value)
    return F.filter(words(vocabulary), lambda word: F.contains(haystack, word))


def non_blank(values: Column) -> Column:
    return F.filter(F.transform(values, lambda value: strip(value)), lambda value: value != "")


def split_on(value: str | Column, pattern: str) -> Column:
    """Split, trim, drop blanks."""
    return non_blank(F.split(text(value), pattern))


def to_string_list(value: str | Column) -> Column:
    """Lenient list parse: JSON or Python list text, else split on separators."""
    body = strip(value)
    parsed = F.from_json(body, "array<string>", {"mode": "PERMISSIVE"})
    listed = F.when(F.startswith(body, F.lit("[")) & F.endswith(body, F.lit("]")), parsed)
    return non_blank(F.coalesce(listed, F.split(body, r"[，,;；/|]")))


def json_or_single(value: str | Column) -> Column:
    """List text parsed as a list; any other text is a list of itself."""
    body = strip(value)
    parsed = F.from_json(body, "array<string>")
    listed = F.when(F.startswith(body, F.lit("[")), parsed)
    return non_blank(F.coalesce(listed, F.array(body)))


def split_label_terms(value: str | Column) -> Column:
    """Label words: punctuation, blanks and the conjunctions 和 及 与 或 separate."""
    parts = F.split(clean_text(value), rf"[、，,；;|/]+|{SPACE}+|和|及|与|或")
    trimmed = F.transform(parts, lambda part: F.regexp_replace(part, r"^[:： ]+|[:： ]+$", ""))
    return non_blank(trimmed)


def split_focus_terms(value: str | Column, generic: Iterable[str] = V.GENERIC_FOCUS_TERMS) -> Column:
    parts = F.split(clean_text(value), r"[、，,；;|/（）()\[\]【】\n]+|以及|或者|并且|且|与|和|或|及")
    trimmed = F.transform(parts, lambda part: F.regexp_replace(part, r"^[ ：:.\-]+|[ ：:.\-]+$", ""))
    long_enough = F.filter(trimmed, lambda part: F.length(part) >= 2)
    return F.array_distinct(F.filter(long_enough, lambda part: ~part.isin(list(generic))))


def multiline_items(value: str | Column) -> Column:
    return F.filter(F.transform(F.split(text(value), r"[\r\n]+"), clean_text), lambda item: item != "")


def category_core(value: str | Column) -> Column:
    """Category name without its Chinese ordinal prefix."""
    return strip(F.regexp_replace(text(value), r"^[一二三四五六七八九十]+、", ""))


def scene_name_tokens(value: str | Column, generic: Iterable[str] = V.GENERIC_TERMS) -> Column:
    """The name itself plus its parts of three or more characters."""
    name = strip(value)
    parts = F.filter(non_blank(F.split(name, r"[（()）/、，,；;]+")), lambda part: F.length(part) >= 3)
    parts = F.filter(parts, lambda part: ~part.isin(list(generic)))
    return F.when(name == "", words([])).otherwise(F.array_distinct(F.concat(F.array(name), parts)))


def phrase_terms(phrases: Column, generic: Iterable[str] = V.GENERIC_TERMS) -> Column:
    """Every phrase followed by its parts of three or more characters, first occurrence kept."""

    def expand(phrase: Column) -> Column:
        parts = F.split(phrase, rf"[（()）/、，,；;\s]+")
        parts = F.filter(non_blank(parts), lambda part: F.length(part) >= 3)
        return F.concat(F.array(phrase), F.filter(parts, lambda part: ~part.isin(list(generic))))

    return F.array_distinct(F.flatten(F.transform(non_blank(phrases), expand)))


def cited_titles(value: str | Column) -> Column:
    """Titles of 2 to 80 characters quoted in 《》."""
    found = F.regexp_extract_all(text(value), F.lit("《([^》]{2,80})》"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, clean_text), lambda title: title != ""))


def truncate(value: str | Column, size: int, mark: str = "...", keep: int | None = None) -> Column:
    """Text cut to ``size`` characters, the mark included unless ``keep`` says otherwise."""
    body = strip(value)
    keep = size - len(mark) if keep is None else keep
    return F.when(F.length(body) <= size, body).otherwise(F.concat(F.substring(body, 1, keep), F.lit(mark)))


def is_true(value: str | Column, accepted: Iterable[str] = V.TRUE_WORDS) -> Column:
    return F.lower(strip(value)).isin(list(accepted))


def strip_code_fence(value: str | Column) -> Column:
    """An external JSON answer without its Markdown fence."""
    return strip(F.regexp_replace(text(value), r"```(json)?\s*", ""))


def first_that(value: str | Column, cases: Iterable[tuple[str, str]], otherwise: str = "") -> Column:
    """Label of the first word that occurs in the text."""
    out = F.lit(otherwise)
    for word, label in reversed(list(cases)):
        out = F.when(F.contains(col(value), F.lit(word)), F.lit(label)).otherwise(out)
    return out


def infer_rule_type(value: str | Column) -> Column:
    body = text(value)
    return (
        F.when(has_any(body, ["不得", "不予受理"]), "PRO_FORBIDDEN")
        .when(has_any(body, ["可以"]), "PER_AUTH")
        .when(body.rlike(r"\d+日内|\d+个月|一致|期限|比较"), "VAL_THRESHOLD")
        .when(has_any(body, ["是指"]), "DEF_SCOPE")
        .when(has_any(body, ["应当", "必须", "须"]), "OBL_MANDATORY")
        .otherwise("EVT_TRIGGER")
    )


def article_hint(value: str | Column) -> Column:
    """Leading article or item number of a clause text, null when there is none."""
    article = F.regexp_extract(text(value), f"^({V.ARTICLE_MARK})", 1)
    item = F.regexp_extract(text(value), r"^([一二三四五六七八九十]+)、", 1)
    return F.coalesce(F.nullif(article, F.lit("")), F.nullif(item, F.lit("")))


def overlap_score(left: str | Column, right: str | Column, normalised: bool = False) -> Column:
    """Share of the left text's characters present in the right one, plus a containment bonus.

    Asymmetric: the left text is the denominator.
    """
    left, right = (col(left), col(right)) if normalised else (comparison_form(left), comparison_form(right))
    # deleting the right text's characters from the left one leaves the unshared ones
    shared = F.length(left) - F.length(F.call_function("translate", left, right, F.lit("")))
    bonus = F.when(F.contains(left, right) | F.contains(right, left), 0.2).otherwise(0.0)
    score = F.least(F.lit(1.0), shared / F.length(left) * 0.8 + bonus)
    return F.when((left == "") | (right == ""), 0.0).otherwise(score)

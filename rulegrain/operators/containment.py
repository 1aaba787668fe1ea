"""Which terms occur in which texts, for dictionaries of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions.text import words, words_in
from rulegrain.session import cut_lineage

MAX_INLINE_TERMS = 32
MAX_AUTOMATON_TERMS = 200_000
MAX_AUTOMATON_CHARACTERS = 16_000_000
GRAM = 3


def _matcher(vocabulary: list[str]):
    """A pandas UDF listing the dictionary terms in each text (one pass over the text)."""

    @F.pandas_udf("array<string>")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in vocabulary:
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            yield batch.map(lambda value: sorted({hit for _, hit in automaton.iter(value)}) if value else [])

    return matches


def matched_terms_column(text: Column, vocabulary: Sequence[str]) -> Column:
    """Array of dictionary terms inside a text, for a dictionary that is already on the driver."""
    vocabulary = sorted({term for term in vocabulary if term})
    if len(vocabulary) <= MAX_INLINE_TERMS:
        return words_in(text, vocabulary)
    return _matcher(vocabulary)(text)


def small_vocabulary(terms: DataFrame) -> list[str] | None:
    """The distinct terms when there are few enough of them, else None; one bounded job."""
    rows = terms.select("term").distinct().limit(MAX_AUTOMATON_TERMS + 1).collect()
    known = [row["term"] for row in rows if row["term"]]
    within = len(rows) <= MAX_AUTOMATON_TERMS and sum(map(len, known)) <= MAX_AUTOMATON_CHARACTERS
    return known if within else None


def with_term_lists(texts: DataFrame, text: str, terms: DataFrame, term: str, alias: str = "terms", strategy: str = "auto") -> DataFrame:
    """``texts`` with the array of the distinct terms each text contains, by the strategies of :func:`find_terms`.

    A dictionary within the automaton's size is looked up inside the rows: nothing is shuffled.
    """
    vocabulary = terms.select(F.col(term).alias("term")).filter(F.length("term") > 0).distinct()
    known = None if strategy == "grams" else small_vocabulary(vocabulary)
    if known is not None:
        return texts.withColumn(alias, matched_terms_column(F.col(text), known))
    numbered = cut_lineage(texts.withColumn("_text_no", F.monotonically_increasing_id()))
    found = _gram_join(numbered.select("_text_no", text), text, vocabulary, ["_text_no"])
    lists = found.groupBy("_text_no").agg(F.collect_list("term").alias(alias))
    return numbered.join(lists, "_text_no", "left").withColumn(alias, F.coalesce(alias, words([]))).drop("_text_no")


def find_terms(
    texts: DataFrame, text: str, terms: DataFrame, term: str, strategy: str = "auto", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of ``texts`` paired with every distinct non-empty ``term`` they contain.

    ``auto`` takes the automaton for a dictionary within a checked size and otherwise the gram
    join, whose cost does not depend on how many terms there are. All strategies return the same
    pairs. ``keep`` names the text columns to carry (all but the text itself by default).
    """
    keep = [name for name in texts.columns if name != text] if keep is None else list(keep)
    vocabulary = terms.select(F.col(term).alias("term")).filter(F.length("term") > 0).distinct()
    known = None if strategy == "grams" else small_vocabulary(vocabulary)
    if strategy == "automaton" and known is None:
        raise ValueError("the dictionary is too large for the automaton strategy")
    if known is not None:
        return texts.select(*keep, F.explode(matched_terms_column(F.col(text), known)).alias("term"))
    return _gram_join(texts, text, vocabulary, keep)


def _windows(reach: int):
    """A pandas UDF listing (size, gram, surrounding text) for each position of a text."""

    @F.pandas_udf("array<struct<size:int,gram:string,around:string>>")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def spread(value: str | None) -> list[tuple[int, str, str]]:
            value = value or ""
            seen = {
                (size, value[at : at + size], value[max(0, at - reach) : at + reach])
                for at in range(len(value))
                for size in range(1, GRAM + 1)
                if at + size <= len(value)
            }
            return [{"size": size, "gram": gram, "around": around} for size, gram, around in seen]

        for batch in batches:
            yield batch.map(spread)

    return windows


def _term_grams(term: Column) -> Column:
    """Grams of a term: all of its 3-grams, or the whole term when it is shorter."""
    last = F.greatest(F.length(term) - F.lit(GRAM - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(term, at, F.lit(GRAM))))


def _gram_join(texts: DataFrame, text: str, vocabulary: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Equi join on each term's rarest n-gram, then verify inside a window around the gram.

    Only the carried columns and a window of twice the longest term travel through the shuffle.
    Choosing the gram that occurs least in the texts keeps a frequent gram from pairing many texts
    with many terms.
    """
    reach = vocabulary.agg(F.max(F.length("term"))).first()[0] or 1
    # a number of its own keeps a row apart from others with the same carried columns
    numbered = texts.withColumn("_row_no", F.monotonically_increasing_id())
    places = numbered.select(
        F.struct("_row_no", *keep).alias("_row"), F.explode(_windows(int(reach))(F.col(text))).alias("_g")
    ).select("_row", "_g.size", "_g.gram", "_g.around")
    seen = places.groupBy("size", "gram").count()
    choices = vocabulary.select(
        "term", F.least(F.length("term"), F.lit(GRAM)).alias("size"), F.explode(_term_grams(F.col("term"))).alias("gram")
    )
    rarest = (
        choices.join(seen, ["size", "gram"], "left")
        .groupBy("term", "size")
        .agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram"))
    )
    pairs = places.join(rarest, ["size", "gram"]).filter(F.contains("around", "term"))
    return pairs.select("_row", "term").distinct().select(*[F.col(f"_row.{name}").alias(name) for name in keep], "term")

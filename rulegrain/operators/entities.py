"""Actors, objects and times in rule text, resolved against alias dictionaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import (
    clean_text, collapse_space, col, ends_with_any, first_that, has_any, lookup_key, once, remove_space, split_label_terms,
    starts_with_any, strip, text, words,
)
from rulegrain.operators.containment import find_terms, matched_terms_column, small_vocabulary
from rulegrain.operators.scale import broadcast_if_small
from rulegrain.session import cut_lineage

CHUNK_BREAK = chr(1)  # in no term, and not whitespace
NO_VALUE = ["未指定", "None", "null"]
RECORD = "struct<name:string,normalized_name:string,aliases:array<string>,matched_aliases:array<string>,source_categories:array<string>,is_normalized:boolean>"


# ------------------------------------------------------------------ dictionaries
def entity_dictionary(rows: DataFrame, category: str = "category", term: str = "term") -> DataFrame:
    """Category and term pairs with categories mapped to their standard names (A3)."""
    mapping = F.create_map(*[F.lit(part) for pair in V.DICTIONARY_CATEGORIES.items() for part in pair])
    raw = strip(category)
    return (
        rows.na.drop(subset=[category, term])
        .select(F.coalesce(F.element_at(mapping, raw), raw).alias("category"), strip(term).alias("term"), raw.alias("_raw"))
        .filter((F.col("_raw") != "实体类别") & (F.col("term") != "词语"))
        .select("category", "term").dropDuplicates()
    )


def reference_terms(rows: DataFrame, group: str, category: str = "category", term: str = "term") -> DataFrame:
    """Terms of one reference group (A4). ``length`` supports the longest-first order."""
    tight = lambda value: F.translate(collapse_space(value), "（） ", "()")
    accepted = sorted({name.replace(" ", "") for name in V.REFERENCE_GROUPS[group]})
    out = rows.select(tight(category).alias("category"), collapse_space(term).alias("term")).filter(
        F.col("category").isin(accepted) & (F.col("term") != "")
    )
    if group == "WHEN":
        out = out.filter(F.length("term") >= 2)
    return out.select("term", F.length("term").alias("length")).distinct()


def with_matches(df: DataFrame, body: Column, terms: DataFrame | None, alias: str, row_id: str) -> DataFrame:
    """Add the dictionary terms contained in a text, longest first.

    A dictionary within the checked size is matched inside the row; a larger one goes through the
    gram join and is gathered per ``row_id``, which must be unique.
    """
    longest_first = lambda found: F.transform(
        F.sort_array(F.transform(found, lambda term: F.struct((-F.length(term)).alias("n"), term.alias("term")))),
        lambda pair: pair["term"],
    )
    if terms is None:
        return df.withColumn(alias, words([]))
    known = small_vocabulary(terms)
    if known is not None:
        return df.withColumn(alias, longest_first(matched_terms_column(body, known)))
    found = find_terms(df.select(row_id, body.alias("_body")), "_body", terms, "term", strategy="grams")
    gathered = found.groupBy(row_id).agg(longest_first(F.collect_set("term")).alias(alias))
    return df.join(gathered, row_id, "left").withColumn(alias, F.coalesce(alias, words([])))


# ------------------------------------------------------------------ raw terms
def _of_value(value: str | Column, terms: Callable[[Column], Column]) -> Column:
    """Terms of a text; none where it stands for no value."""
    absent = lambda body: (body == "") | (F.lower(body) == "nan") | body.isin(NO_VALUE)
    return once(clean_text(value), lambda body: F.when(~absent(body), terms(body)).otherwise(words([])))


def _led_by_whole(body: Column, parts: Column, allowed: Column) -> Column:
    return once(parts, lambda listed: F.when(allowed & ~F.array_contains(listed, body), F.concat(F.array(body), listed)).otherwise(listed))


def actor_terms(value: str | Column, known: Column | None = None, limit: int = 20) -> Column:
    known = words([]) if known is None else known
    return _of_value(value, lambda body: F.slice(F.array_distinct(F.concat(_led_by_whole(body, split_label_terms(body), F.lit(True)), known)), 1, limit))


def object_terms(value: str | Column, known: Column | None = None, limit: int = 20) -> Column:
    known = words([]) if known is None else known

    def terms(body: Column) -> Column:
        short = (F.length(body) <= 30) & ~has_any(body, ["；", ";", "、"])
        merged = F.array_distinct(F.concat(known, _led_by_whole(body, split_label_terms(body), short)))
        kept = F.filter(
            F.transform(merged, clean_text),
            lambda term: (F.length(term) > 1)
            & ((F.length(term) != 2) | term.isin(V.TWO_CHARACTER_OBJECTS))
            & ~has_any(term, ["；", ";"]),
        )
        return F.slice(kept, 1, limit)

    return _of_value(value, terms)


def time_terms(value: str | Column, known: Column | None = None, limit: int = 15) -> Column:
    known = words([]) if known is None else known
    separators = ["；", ";", "、", "，", ","]

    def shaped(term: Column) -> Column:
        return (
            ends_with_any(term, V.WHEN_ENDINGS) | term.rlike(r"\d") | has_any(term, V.WHEN_WORDS)
            | F.startswith(term, F.lit("每"))
        )

    def terms(body: Column) -> Column:
        short = (F.length(body) <= 28) & ~has_any(body, separators)
        merged = F.array_distinct(F.concat(known, _led_by_whole(body, split_label_terms(body), short)))
        kept = F.filter(
            F.transform(merged, clean_text),
            lambda term: (term != "") & ~has_any(term, separators)
            & ((F.length(term) > 2) | term.isin(V.WHEN_SHORT_TERMS)) & shaped(term),
        )
        return F.slice(kept, 1, limit)

    return _of_value(value, terms)


def without_whole(terms: str | Column, value: str | Column) -> Column:
    """Terms for record resolution: the undivided text is dropped when parts exist."""
    whole = clean_text(value)
    first = lambda listed: (F.size(listed) > 1) & (F.get(listed, F.lit(0)) == whole)
    return once(col(terms), lambda listed: F.when(first(listed), F.slice(listed, F.lit(2), F.size(listed))).otherwise(listed))


# ------------------------------------------------------------------ confidence tests
def confident_object(value: Column) -> Column:
    low = (
        value.isin(V.OBJECT_BLOCKLIST) | (F.length(value) <= 1)
        | ((F.length(value) == 2) & ~value.isin(V.TWO_CHARACTER_OBJECTS))
        | value.rlike(r"^[0-9A-Za-z+\-（）()]+$")
    )
    refused = ends_with_any(value, V.OBJECT_REJECT_ENDINGS) | has_any(value, V.OBJECT_REJECT_WORDS)
    title = F.startswith(value, F.lit("《")) & F.endswith(value, F.lit("》"))
    return ~low & ~refused & (ends_with_any(value, V.OBJECT_SUFFIXES) | has_any(value, V.OBJECT_CORE_WORDS) | title)


def time_fragment(value: str | Column) -> Column:
    return remove_space(F.translate(collapse_space(value), "（）", "()"))


def confident_fragment(body: Column) -> Column:
    """Whether a normalised time fragment is a time."""
    shape = "^(?:" + "|".join(f"(?:{pattern})" for pattern in V.TIME_CONFIDENT_PATTERNS) + ")$"
    refused = (
        (body == "") | body.isin(V.TIME_BLOCKLIST) | starts_with_any(body, V.TIME_REJECT_STARTS)
        | has_any(body, V.TIME_REJECT_WORDS) | ((F.length(body) <= 2) & ~body.isin(V.TIME_FIXED_TERMS))
        | has_any(body, ["、", "；", ";", "，", ",", "/", "／"])
    )
    return ~refused & body.rlike(shape)


def confident_times(values: Column) -> Column:
    """The raw terms whose normalised form is a time."""
    paired = F.transform(values, lambda value: F.struct(value.alias("value"), time_fragment(value).alias("body")))
    return F.transform(F.filter(paired, lambda pair: confident_fragment(pair["body"])), lambda pair: pair["value"])


def time_phrases(values: Column) -> Column:
    """Event times reduced to action + object family + suffix, confident and distinct (C11).

    Each step is its own transform, so a step reads the one before instead of repeating it.
    """
    bodies = F.transform(values, time_fragment)

    def ending(body: Column) -> Column:
        suffix = F.lit("")
        for word in reversed(V.TIME_SUFFIXES):
            suffix = F.when(F.endswith(body, F.lit(word)), word).otherwise(suffix)
        return F.struct(body.alias("body"), suffix.alias("suffix"))

    def stem(item: Column) -> Column:
        length = F.length(item["body"]) - F.length(item["suffix"])
        return F.struct(item["body"].alias("body"), item["suffix"].alias("suffix"), F.substring(item["body"], F.lit(1), length).alias("stem"))

    def parts(item: Column) -> Column:
        fixed = (item["suffix"] == "") | item["stem"].rlike(r"\d|^T[+-]")
        action = first_that(item["stem"], [(word, word) for word in V.TIME_ACTIONS])
        family = first_that(item["stem"], V.TIME_FAMILIES)
        return F.struct(item["body"].alias("body"), item["suffix"].alias("suffix"), F.when(fixed, "").otherwise(F.concat(action, family)).alias("core"))

    steps = F.transform(F.transform(F.transform(bodies, ending), stem), parts)
    phrases = F.transform(steps, lambda item: F.when(item["core"] == "", item["body"]).otherwise(F.concat(item["core"], item["suffix"])))
    return F.array_distinct(F.filter(phrases, confident_fragment))


# ------------------------------------------------------------------ alias index (C4)
@dataclass(frozen=True)
class AliasIndex:
    canonical: DataFrame  # name, aliases, source_categories
    exact: DataFrame  # key, name
    aliases: DataFrame  # term, name


def alias_index(pairs: DataFrame, categories: list[str]) -> AliasIndex:
    """Canonical records, exact keys and alias terms; a key with two canonical names is dropped."""
    rows = pairs.select(*[collapse_space(name).alias(name) for name in ("category", "alias", "canonical")]).filter(
        F.col("category").isin(categories) & ~F.startswith("category", F.lit("▶"))
        & (F.col("alias") != "") & (F.col("canonical") != "")
    )
    surfaces = rows.select("canonical", "category", F.explode(F.array("alias", "canonical")).alias("surface")).distinct()
    longest_first = F.transform(
        F.sort_array(F.collect_set(F.struct((-F.length("surface")).alias("n"), F.col("surface").alias("value")))),
        lambda pair: pair["value"],
    )
    canonical = surfaces.groupBy(F.col("canonical").alias("name")).agg(
        longest_first.alias("aliases"), F.sort_array(F.collect_set("category")).alias("source_categories")
    )
    keyed = surfaces.select(lookup_key("surface").alias("key"), "surface", "canonical").distinct()
    exact = (
        keyed.groupBy("key").agg(F.countDistinct("canonical").alias("targets"), F.min("canonical").alias("name"))
        .filter((F.col("targets") == 1) & (F.col("key") != "")).select("key", "name")
    )
    aliases = keyed.join(exact, "key").select(F.col("surface").alias("term"), "name").distinct()
    return AliasIndex(cut_lineage(canonical), cut_lineage(exact), cut_lineage(aliases))


def plain_record(name: Column, categories: list[str], is_normalized: bool) -> Column:
    return F.struct(
        name.alias("name"), name.alias("normalized_name"), F.array(name).alias("aliases"),
        F.array(name).alias("matched_aliases"), words(categories).alias("source_categories"),
        F.lit(is_normalized).alias("is_normalized"),
    )


def _search_rows(df: DataFrame, row_id: str, body: Column, raw: Column) -> DataFrame:
    cleaned = F.array_distinct(F.filter(F.transform(raw, collapse_space), lambda term: term != ""))
    rows = df.select(row_id, collapse_space(body).alias("body"), cleaned.alias("raw"))
    lead = F.when(F.col("body") != "", F.array("body")).otherwise(words([]))
    return rows.withColumn("chunks", F.array_distinct(F.concat(lead, "raw")))


def resolve_records(rows: DataFrame, row_id: str, index: AliasIndex, fallback: bool = True) -> DataFrame:
    """Canonical records of each text: exact key hits, then aliases in the text, then raw terms.

    ``rows`` has (row_id, body, raw, chunks). Returns (row_id, order, record); groups are the hits of
    one text, so no group grows with the corpus.
    """
    raw = rows.select(row_id, F.posexplode("raw").alias("at", "term"))
    exact = raw.withColumn("key", lookup_key("term")).join(broadcast_if_small(index.exact), "key").select(
        row_id, "name", F.struct(F.lit(0).alias("phase"), F.col("at").alias("at"), F.lit(0).alias("n"), F.col("term").alias("alias")).alias("at"),
        F.col("term").alias("alias"), F.col("term").alias("used"),
    )
    chunks = rows.select(row_id, "raw", F.posexplode("chunks").alias("chunk_no", "chunk")).withColumn(
        "used", F.when(F.array_contains("raw", F.col("chunk")), F.col("chunk"))
    )
    found = find_terms(chunks, "chunk", index.aliases, "term", keep=[row_id, "chunk_no", "used"])
    inside = found.join(broadcast_if_small(index.aliases), "term").select(
        row_id, "name",
        F.struct(F.lit(1).alias("phase"), F.col("chunk_no").alias("at"), (-F.length("term")).alias("n"), F.col("term").alias("alias")).alias("at"),
        F.col("term").alias("alias"), "used",
    )
    hits = exact.unionByName(inside)
    named = (
        hits.groupBy(row_id, "name", "alias").agg(F.min("at").alias("at"))
        .groupBy(row_id, "name").agg(F.min("at").alias("order"), F.sort_array(F.collect_list(F.struct("at", "alias"))).alias("m"))
    )
    records = named.join(broadcast_if_small(index.canonical), "name").select(
        row_id, "order",
        F.struct(
            F.col("name"), F.col("name").alias("normalized_name"), F.col("aliases"),
            F.transform("m", lambda pair: pair["alias"]).alias("matched_aliases"), F.col("source_categories"),
            F.lit(True).alias("is_normalized"),
        ).alias("record"),
    )
    if not fallback:
        return records
    leftover = rows.select(row_id, F.posexplode(F.when(F.size("raw") > 0, F.col("raw")).otherwise(F.slice("chunks", 1, 1))).alias("at", "term"))
    used = hits.filter(F.col("used").isNotNull()).select(row_id, F.col("used").alias("term")).union(
        named.select(row_id, F.col("name").alias("term"))
    ).distinct()
    rest = leftover.join(used, [row_id, "term"], "left_anti").select(
        row_id,
        F.struct(F.lit(2).alias("phase"), F.col("at").alias("at"), F.lit(0).alias("n"), F.col("term").alias("alias")).alias("order"),
        plain_record(F.col("term"), [], False).alias("record"),
    )
    return records.union(rest)


def _by_text(df: DataFrame, row_id: str, body: str | Column, raw: Column, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(row_id, order, record) of every row; rows of the same text and raw terms share one resolution.

    ``build`` gets the distinct (text_no, body, raw) and returns (text_no, order, record).
    """
    rows = df.select(row_id, text(body).alias("_body"), F.coalesce(raw, words([])).alias("_raw"))
    texts = cut_lineage(rows.select("_body", "_raw").distinct().withColumn("text_no", F.monotonically_increasing_id()))
    records = build(texts.select("text_no", F.col("_body").alias("body"), F.col("_raw").alias("raw")))
    found = cut_lineage(texts.join(records, "text_no").groupBy("_body", "_raw").agg(F.collect_list(F.struct("order", "record")).alias("_found")))
    return rows.join(broadcast_if_small(found), ["_body", "_raw"]).select(row_id, F.inline("_found"))


def actor_records(df: DataFrame, row_id: str, body: str | Column, raw: Column, index: AliasIndex) -> DataFrame:
    """(row_id, order, record) for actors."""
    return _by_text(df, row_id, body, raw, lambda texts: resolve_records(_search_rows(texts, "text_no", F.col("body"), F.col("raw")), "text_no", index))


def confidence(record: Column) -> Column:
    return (
        F.when(record["is_normalized"], 3).otherwise(0) + F.when(F.size(record["source_categories"]) > 0, 2).otherwise(0)
        + F.when(F.length(record["name"]) >= 4, 1).otherwise(0)
    )


def prune_subsumed(records: Column) -> Column:
    """Drop records whose name overlaps a more trustworthy one."""

    def beaten(record: Column) -> Column:
        def by(other: Column) -> Column:
            mine, theirs = record["name"], other["name"]
            inside, around = F.contains(theirs, mine), F.contains(mine, theirs)
            stronger = confidence(other) > confidence(record)
            longer = (confidence(other) == confidence(record)) & (F.length(mine) < F.length(theirs))
            return (theirs != "") & (theirs != mine) & (((inside | around) & stronger) | (inside & longer))

        return F.exists(records, by)

    return F.filter(records, lambda record: (record["name"] != "") & ~beaten(record))


def _pruned(records: DataFrame, row_id: str) -> DataFrame:
    """First record per name in order, pruned within each text."""
    first = records.groupBy(row_id, "record.name").agg(F.min_by("record", "order").alias("record"), F.min("order").alias("order"))
    listed = first.groupBy(row_id).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("order", "record"))), lambda pair: pair["record"]).alias("records")
    )
    kept = listed.select(row_id, F.posexplode(prune_subsumed(F.col("records"))).alias("order", "record"))
    return kept


def object_records(
    df: DataFrame, row_id: str, body: str | Column, raw: Column, index: AliasIndex, dictionary: DataFrame,
) -> DataFrame:
    """Objects: canonical records, then dictionary terms, then raw terms, pruned."""
    return _by_text(df, row_id, body, raw, lambda texts: _object_records(texts, "text_no", "body", F.col("raw"), index, dictionary))


def _object_records(
    df: DataFrame, row_id: str, body: str | Column, raw: Column, index: AliasIndex, dictionary: DataFrame,
) -> DataFrame:
    rows = _search_rows(df, row_id, col(body), F.filter(F.transform(raw, collapse_space), confident_object))
    alone = (F.size("raw") == 0) & confident_object(F.col("body"))
    rows = rows.withColumn("raw", F.when(alone, F.array("body")).otherwise(F.col("raw")))
    lead = F.when(F.col("body") != "", F.array("body")).otherwise(words([]))
    rows = rows.withColumn("chunks", F.array_distinct(F.concat(lead, "raw")))
    place = lambda phase, at, term: F.struct(
        F.lit(phase).alias("phase"), F.col(at).alias("at"), (-F.length(term)).alias("n"), F.col(term).alias("alias")
    ).alias("order")
    known = resolve_records(rows, row_id, index, fallback=False)
    chunks = rows.select(row_id, F.posexplode("chunks").alias("at", "chunk"))
    confident = dictionary.filter(confident_object(F.col("term")))
    listed = find_terms(chunks, "chunk", confident, "term", keep=[row_id, "at"]).select(
        row_id, place(3, "at", "term"), plain_record(F.col("term"), [V.OBJECT_SOURCE_CATEGORY], False).alias("record")
    )
    spoken = rows.select(row_id, F.posexplode("raw").alias("at", "term")).select(
        row_id, F.struct(F.lit(4).alias("phase"), F.col("at").alias("at"), F.lit(0).alias("n"), F.col("term").alias("alias")).alias("order"),
        plain_record(F.col("term"), [], False).alias("record"),
    )
    return _pruned(known.union(listed).union(spoken), row_id)


def _search_times(chunks: Column) -> Column:
    """Time expressions of each normalised chunk in turn; a hit inside an earlier hit is skipped."""

    def longest_first(found: Column) -> Column:
        keyed = F.transform(found, lambda hit, at: F.struct((-F.length(hit)).alias("n"), at.alias("at"), hit.alias("hit")))
        return F.transform(F.sort_array(keyed), lambda item: item["hit"])

    def add_unless_inside(seen: Column, hit: Column) -> Column:
        inside = F.exists(seen, lambda known: (known != hit) & F.contains(known, hit))
        return F.when(inside, seen).otherwise(F.concat(seen, F.array(hit)))

    def step(seen: Column, body: Column) -> Column:
        seen = F.concat(seen, F.filter(words(V.TIME_FIXED_TERMS), lambda term: F.contains(body, term)))
        for pattern in V.TIME_SEARCH_PATTERNS:
            found = longest_first(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
            seen = F.aggregate(found, seen, add_unless_inside)
        parts = F.filter(F.split(body, "[、，,；;|/]+"), lambda part: part.rlike(f"^{V.TIME_SCENE_ENDINGS}$"))
        return F.concat(seen, parts)

    return F.aggregate(chunks, words([]), step)


def time_records(df: DataFrame, row_id: str, body: str | Column, raw: Column, dictionary: DataFrame | None) -> DataFrame:
    """Times: patterns and dictionary hits first, confident raw terms after them, pruned."""
    return _by_text(df, row_id, body, raw, lambda texts: _time_records(texts, "text_no", "body", F.col("raw"), dictionary))


def _time_records(df: DataFrame, row_id: str, body: str | Column, raw: Column, dictionary: DataFrame | None) -> DataFrame:
    rows = _search_rows(df, row_id, col(body), confident_times(F.transform(raw, collapse_space)))
    if dictionary is not None:
        dictionary = dictionary.withColumn("term", time_fragment("term")).filter(F.col("term") != "")
    rows = with_matches(rows, time_fragment(F.array_join("chunks", CHUNK_BREAK)), dictionary, "listed", row_id)
    rows = rows.withColumn("seen", F.array_distinct(F.concat(_search_times(F.transform("chunks", time_fragment)), "listed")))
    found = rows.select(row_id, time_phrases(F.col("raw")).alias("weak"), time_phrases(F.col("seen")).alias("strong"))
    weak = F.array_except("weak", "strong")
    records = F.concat(
        F.transform("strong", lambda name: plain_record(name, [V.TIME_SOURCE_CATEGORY], True)),
        F.transform(weak, lambda name: plain_record(name, [], False)),
    )
    return found.select(row_id, F.posexplode(prune_subsumed(records)).alias("order", "record"))


def matched_actor_terms(wanted: str | Column, who: str | Column, terms: str | Column) -> Column:
    """Wanted actor words that occur in the text or among its terms."""
    body = clean_text(who)
    return F.array_distinct(F.filter(col(wanted), lambda term: F.contains(body, term) | F.array_contains(col(terms), term)))

"""Documents to lines, chunks and clause segments; extracted rules to atom rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import clean_text, col, non_blank, split_on, strip, text
from rulegrain.operators.scale import carry_forward, number_rows, running_sum, top_rows


def document_lines(documents: DataFrame, key: str, body: str, keep_blank: bool = False) -> DataFrame:
    """One row per line with a dense line number from 1; blank lines are dropped by default."""
    lines = F.split(text(body), "\n")
    lines = F.transform(lines, clean_text)
    if not keep_blank:
        lines = F.filter(lines, lambda line: line != "")
    numbered = documents.select(key, F.posexplode(lines).alias("_at", "line"))
    return numbered.select(key, (F.col("_at") + 1).alias("line_no"), "line")


def chunk_bounds(lines: Column, limit: int = 1000, nice: int = 300, article: str = V.CHUNK_ARTICLE_START) -> Column:
    """Start positions of the chunks of a line array, closing position included.

    The fold keeps only the positions and the running length, so a long document costs one pass.
    """

    def state(bounds: Column, length: Column, at: Column) -> Column:
        return F.struct(bounds.alias("bounds"), length.alias("length"), at.alias("at"))

    def step(acc: Column, line: Column) -> Column:
        width = F.length(line)
        split = (line.rlike(article) & (acc["length"] > nice)) | (acc["length"] + width > limit)
        return F.when(split, state(F.concat(acc["bounds"], F.array(acc["at"])), width, acc["at"] + 1)).otherwise(
            state(acc["bounds"], acc["length"] + width, acc["at"] + 1)
        )

    start = state(F.array(F.lit(1)), F.lit(0), F.lit(1))
    return F.aggregate(lines, start, step, lambda acc: F.concat(acc["bounds"], F.array(acc["at"])))


def chunk_documents(
    documents: DataFrame, key: str, body: str, limit: int = 1000, per_document: int | None = None, compat: bool = True,
    nice: int = 300, article: str = V.CHUNK_ARTICLE_START,
) -> DataFrame:
    """Chunks of consecutive lines, with no shuffle: each document is folded inside its row.

    With ``compat`` an oversized first line leaves an empty chunk before it.
    """
    lines = F.split(text(body), "\n")
    folded = documents.select(key, lines.alias("lines")).withColumn("bounds", chunk_bounds(F.col("lines"), limit, nice, article))
    spans = F.transform(
        F.sequence(F.lit(1), F.size("bounds") - 1),
        lambda at: F.array_join(
            F.slice(F.col("lines"), F.element_at("bounds", at), F.element_at("bounds", at + 1) - F.element_at("bounds", at)), "\n"
        ),
    )
    if not compat:
        spans = F.filter(spans, lambda chunk: chunk != "")
    chunks = folded.select(key, F.posexplode(spans).alias("_at", "content_original"))
    chunks = chunks.select(key, (F.col("_at") + 1).alias("chunk_index"), "content_original")
    return chunks if not per_document else chunks.filter(F.col("chunk_index") <= per_document)


def cap_chunks(chunks: DataFrame, key: str, per_document: int) -> DataFrame:
    """First chunks of each document for chunk tables from elsewhere."""
    return top_rows(chunks, [key], [F.col("chunk_index")], per_document, "_rank").drop("_rank")


def _islands(marked: DataFrame, key: str, mark: str) -> DataFrame:
    """Number the stretches opened by a non-null mark; lines before the first mark are dropped."""
    numbered = running_sum(marked, [key], "line_no", F.col(mark).isNotNull().cast("int"), "island")
    return numbered.filter(F.col("island") > 0)


def _island_texts(islands: DataFrame, key: str, opened: Column) -> DataFrame:
    """One row per kept island: its reference and its lines in order."""
    head = islands.groupBy(key, "island").agg(
        F.max(opened).alias("ref"),
        F.min("line_no").alias("seg_ord"),
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines"),
    )
    return head.filter(F.col("ref").isNotNull()).withColumn("lines", F.transform("_lines", lambda pair: pair["line"]))


def article_segments(
    lines: DataFrame, key: str, article: str = V.ARTICLE_MARK, section: str = V.SECTION_MARK, compat: bool = True,
) -> DataFrame:
    """Article blocks and their paragraphs from a line table.

    Articles and section headings both open an island; islands opened by a heading are dropped
    before anything is gathered. A hot document costs block-sized windows, not one big one.
    """
    ref = F.nullif(F.regexp_extract("line", f"^({article})", 1), F.lit(""))
    heading = F.when(F.col("line").rlike(f"^{section}"), "")
    marked = lines.withColumn("ref", ref).withColumn("mark", F.coalesce(ref, heading))
    islands = _islands(marked, key, "mark")
    # A heading line carries the empty mark, so its island has no article reference.
    kept = carry_forward(islands, [key], "line_no", "mark", "open").filter(F.col("open") != "")
    blocks = _island_texts(kept, key, F.col("ref"))
    block = blocks.select(
        F.concat_ws(":", key, "ref", F.lit("BLOCK")).alias("id"), F.col(key).alias("doc"), "ref",
        F.lit("article_block").alias("type"), F.array_join("lines", "\n").alias("text"), "seg_ord", F.lit(0).alias("part"),
    )
    paragraph = blocks.select(key, "ref", "seg_ord", F.posexplode("lines").alias("_at", "text")).select(
        F.concat(F.concat_ws(":", key, "ref"), F.lit(":P"), F.col("_at") + 1).alias("id"), F.col(key).alias("doc"),
        F.concat(F.col("ref"), F.lit("#P"), F.col("_at") + 1).alias("ref"),
        F.lit("article_paragraph").alias("type"), "text", "seg_ord", (F.col("_at") + 1).alias("part"),
    )
    return block.unionByName(paragraph)


def first_line_where(lines: DataFrame, key: str, test: Column, alias: str) -> DataFrame:
    return lines.filter(test).groupBy(key).agg(F.min("line_no").alias(alias))


def payment_segments(
    lines: DataFrame, key: str, title: str = V.APPENDIX_TITLE, stop: str = V.SECOND_APPENDIX, prefix: str = V.FIRST_APPENDIX,
) -> DataFrame:
    """Articles before the appendix title, then appendix items and sub-items up to the stop line."""
    titled = first_line_where(lines, key, F.startswith("line", F.lit(title)), "title_at")
    placed = lines.join(titled, key, "left")
    body = placed.filter(F.col("title_at").isNull() | (F.col("line_no") < F.col("title_at"))).drop("title_at")
    tail = placed.filter(F.col("line_no") >= F.col("title_at"))
    stopped = first_line_where(tail, key, F.startswith("line", F.lit(stop)), "stop_at")
    tail = (
        tail.join(stopped, key, "left")
        .filter(F.col("stop_at").isNull() | (F.col("line_no") < F.col("stop_at")))
        .filter(~F.startswith("line", F.lit(title)) & (F.col("line") != ""))
    )
    item = F.nullif(F.regexp_extract("line", r"^([一二三四五六七八九十]+)、", 1), F.lit(""))
    islands = _islands(tail.withColumn("item", item), key, "item")
    items = _island_texts(islands, key, F.col("item")).select(
        F.concat(F.col(key), F.lit(f":{prefix}-"), F.col("ref"), F.lit(":BLOCK")).alias("id"), F.col(key).alias("doc"),
        F.concat(F.lit(f"{prefix}-"), F.col("ref")).alias("ref"), F.lit("appendix_item").alias("type"),
        F.array_join("lines", "\n").alias("text"), "seg_ord", F.lit(0).alias("part"),
    )
    inside = carry_forward(islands, [key], "line_no", "item", "open_item")
    sub = F.regexp_extract("line", f"^({V.SUBITEM_MARK})", 1)
    subitems = inside.withColumn("sub", sub).filter((F.col("sub") != "") & F.col("item").isNull()).select(
        F.concat(F.col(key), F.lit(f":{prefix}-"), F.col("open_item"), F.col("sub")).alias("id"), F.col(key).alias("doc"),
        F.concat(F.lit(f"{prefix}-"), F.col("open_item"), F.col("sub")).alias("ref"),
        F.lit("appendix_subitem").alias("type"), F.col("line").alias("text"), F.col("line_no").alias("seg_ord"), F.lit(0).alias("part"),
    )
    return article_segments(body, key).unionByName(items).unionByName(subitems)


def legal_segments(lines: DataFrame, key: str, title: str = V.APPENDIX_TITLE) -> DataFrame:
    """Generic segmentation: appendix headers, articles, section headings, appendix items."""
    line = F.col("line")
    header = F.nullif(F.regexp_extract(line, f"^({V.APPENDIX_MARK})", 1), F.lit(""))
    article = F.nullif(F.regexp_extract(line, f"^({V.ARTICLE_MARK})", 1), F.lit(""))
    titled = F.startswith(line, F.lit(title))
    kind = (
        F.when(titled, "title").when(header.isNotNull(), "header").when(article.isNotNull(), "article")
        .when(line.rlike(f"^{V.SECTION_MARK}"), "section")
        .when(line.rlike(r"^[一二三四五六七八九十]+、"), "item")
    )
    # "" means "no appendix is open"; null lines inherit.
    appendix = (
        F.when(F.col("kind") == "title", V.FIRST_APPENDIX).when(F.col("kind") == "header", header)
        .when(F.col("kind") == "article", "")
    )
    marked = lines.withColumn("kind", kind).withColumn("sets_appendix", appendix)
    carried = carry_forward(marked, [key], "line_no", "sets_appendix", "appendix")
    live_item = (F.col("kind") == "item") & (F.coalesce("appendix", F.lit("")) != "")
    mark = (
        F.when(F.col("kind") == "header", header).when(F.col("kind") == "article", article)
        .when(F.col("kind").isin("section", "title"), "")
        .when(live_item, F.concat_ws("-", "appendix", F.regexp_extract(line, r"^([一二三四五六七八九十]+)、", 1)))
    )
    islands = _islands(carried.withColumn("mark", mark), key, "mark")
    kept = carry_forward(islands, [key], "line_no", "mark", "open").filter(F.col("open") != "")
    return _island_texts(kept, key, F.col("mark")).select(
        F.col(key).alias("doc"), "ref", F.array_join("lines", "\n").alias("text"), "seg_ord"
    )


def split_citations(sources: DataFrame, body: str, appendix: str | Column | None = None) -> DataFrame:
    """Citation texts split before each article mark, or before each item for appendix sources."""
    content = strip(body)
    articles = F.split(content, f"(?={V.ARTICLE_MARK})")
    parts = articles
    if appendix is not None:
        # an item mark inside a longer numeral must not split: Java would cut 十一、 twice
        items = F.split(F.regexp_replace(content, r"^附一[:：]?\s*", ""), f"(?<![一二三四五六七八九十])(?={V.ITEM_MARK})")
        parts = F.when(col(appendix), items).otherwise(articles)
    return sources.select(
        *[name for name in sources.columns if name != body], F.posexplode(non_blank(parts)).alias("chunk_no", "chunk")
    )


def flatten_atoms(nested: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Nested extracted rules to flat atom rows with ids YZ-{code}-{type}-{number}.

    ``order`` is the reading order (document, chunk, position); numbering runs over all rows.
    """
    parts = ["who", "when", "where", "what", "how"]
    kinds = {field.name: field.dataType.typeName() for field in nested.schema["behavior_struct"].dataType.fields}

    def part(name: str) -> Column:
        value = F.col(f"behavior_struct.`{name}`")
        if kinds[name] == "array":
            value = F.array_join(F.filter(value, lambda item: item.isNotNull() & (item != "")), "、")
        return F.coalesce(value, F.lit(V.UNSPECIFIED)).alias(name)

    flat = nested.select(*[name for name in nested.columns if name != "behavior_struct"], *[part(name) for name in parts])
    code = F.lit("GEN")
    for word, value in reversed(V.DOCUMENT_CODES):
        code = F.when(F.contains("source_document", F.lit(word)), value).otherwise(code)
    kind = F.substring_index(F.coalesce("rule_type", F.lit("UNKNOWN")), "_", 1)
    numbered = number_rows(flat, order, "atom_no", start)
    return numbered.withColumn("atom_id", F.concat_ws("-", F.lit("YZ"), code, kind, F.format_string("%05d", "atom_no")))


def parse_query_specs(queries: DataFrame, raw: str, who_terms) -> DataFrame:
    """Split "query::who" or "query@@who" and extract the actor words."""
    body = clean_text(raw)
    separator = F.when(F.contains(body, F.lit("::")), "::").when(F.contains(body, F.lit("@@")), "@@")
    at = F.instr(body, F.lit("::"))
    at = F.when(F.contains(body, F.lit("::")), F.instr(body, F.lit("::"))).otherwise(F.instr(body, F.lit("@@")))
    query = F.when(separator.isNull(), body).otherwise(F.substring(body, F.lit(1), at - 1))
    who = F.when(separator.isNull(), "").otherwise(F.substring(body, at + 2, F.length(body)))
    out = queries.withColumn("raw_query", body).withColumn("query", strip(query)).withColumn("_who", who)
    return out.withColumn("who_terms", F.array_distinct(who_terms(F.col("_who")))).drop("_who")


def batch_questions(lines: DataFrame, line: str = "value", default_query: str = "", default_who: str = "") -> DataFrame:
    """Question lines "question | query | who" to items; comments and blanks are skipped."""
    body = strip(line)
    kept = lines.withColumn("_line", body).filter((F.col("_line") != "") & ~F.startswith("_line", F.lit("#")))
    cells = F.split("_line", r"\s*(?:\t+|\||｜)\s*", 3)
    cell = lambda at: F.coalesce(strip(F.get(cells, F.lit(at))), F.lit(""))
    kept = kept.withColumn("question", cell(0)).filter(F.col("question") != "")
    query = F.coalesce(F.nullif(cell(1), F.lit("")), F.nullif(F.lit(default_query.strip()), F.lit("")), F.col("question"))
    inline = F.contains("query", F.lit("::")) | F.contains("query", F.lit("@@"))
    who = F.coalesce(F.nullif(cell(2), F.lit("")), F.when(inline, "").otherwise(F.lit(default_who.strip())))
    items = kept.withColumn("query", query).withColumn("who", who)
    return number_rows(items.select("line_no", "question", "query", "who"), ["line_no"], "index")


def cleaned_lines(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Line table with a rule-type guess, for corpora without extracted rules."""
    from rulegrain.functions.text import infer_rule_type

    return document_lines(documents, key, body).withColumn("rule_type", infer_rule_type("line"))


def split_terms_table(rows: DataFrame, key: str, value: str, pattern: str) -> DataFrame:
    return rows.select(key, F.explode(split_on(value, pattern)).alias("term"))

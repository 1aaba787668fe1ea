"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulegrain.llm.common import WORD, stored, table, text_of
from rulegrain.operators.scale import number_rows

BITS, STEP = 52, 12


def _lots(rows: DataFrame) -> Column:
    """A uniform number in (0, 1) from the digest of id and text; the same in every run and engine."""
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << BITS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to a table of ``source`` and ``source_size``.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``total`` times all sizes.
    A target stops at ``most`` times its source; what is over is shared again by weight until none is above.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "__number", 0)
    ranked = stored(ranked.select("source", "source_size", F.element_at(cycle, (F.col("__number") % len(weights) + 1).cast("int")).alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    level, full = -1.0, None
    while True:  # the level only rises; each round is one sum over the sources
        over = cap < F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("capped"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (total * row["all"] - row["capped"]) / row["open"]
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def mix_plan(docs: DataFrame, weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             **targets) -> tuple[DataFrame, DataFrame]:
    """Rows (id, source, size, whole, key) and, for each source, its size, target and cut.

    A document is expected ``target / source_size * weight / mean weight`` times, at most twice. Its whole
    copies are certain; the rest is an inclusion probability p, and its key ranks u / (1 - u) over p / (1 - p)
    (u: a fixed random number). Of each source the lowest keys are taken until the sample has its fixed
    size: the words that the whole copies leave of the target, plus one document that fits the gap best.
    A document larger than that room can only be this last one. The cut is found by
    two rounds of sums over 4,096 key ranges, then inside one range, so a source of any size is never sorted.
    """
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(source_col).alias("source"), weight.alias("weight"))
    rows = stored(base.select("id", "source", "weight", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), _lots(base).alias("lot")))
    totals = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("weighed")))
    goals = source_targets(totals.select("source", "source_size"), **targets)
    goals = stored(goals.join(totals.select(F.col("source").alias("__source"), "weighed"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    keyed = by_source(rows, goals).select("id", "source", "size", *expected_copies())
    budget = stored(
        keyed.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
        .join(goals.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("room", F.col("target") - F.col("certain"))
    )
    open_rows = keyed.filter("key IS NOT NULL AND size > 0").select("source", "size", "key", "id")
    for level in (1, 2):
        shift = BITS - STEP * level
        inside = by_source(open_rows, budget).filter((F.col("size") <= F.col("room")) & (F.shiftright("key", shift + STEP) == F.col("prefix")))
        parts = inside.groupBy("source", "before", "room", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = parts.withColumn("running", F.col("before") + F.sum("words").over(order))
        crosses = F.col("running") >= F.col("room")
        first = Window.partitionBy("source").orderBy(~crosses, "bucket")
        whole = F.max("running").over(Window.partitionBy("source"))
        crossing = sums.withColumn("__whole", whole).withColumn("__first", F.row_number().over(first)).filter("__first = 1")
        crossing = crossing.select(
            F.col("source").alias("__source"), F.when(crosses, F.col("bucket")).otherwise(-1).alias("__prefix"),
            F.when(crosses, F.col("running") - F.col("words")).otherwise(F.col("__whole")).alias("__before"))
        budget = stored(
            budget.join(crossing, F.col("source").eqNullSafe(F.col("__source")), "left")
            # a source whose open documents all fit keeps no range: everything is taken
            .withColumn("prefix", F.coalesce("__prefix", F.lit(-1).cast("long"))).withColumn("before", F.coalesce("__before", "before"))
            .drop("__source", "__prefix", "__before")
        )
    last = by_source(open_rows, budget).filter((F.col("size") <= F.col("room")) & (F.shiftright("key", BITS - 2 * STEP) == F.col("prefix")))
    running = F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_last()))  # equal rows share one fate
    reached = last.withColumn("running", F.col("before") + running).filter("running <= room")
    cuts = reached.groupBy("source").agg(F.max(F.struct("running", "key", F.col("id").isNull().alias("null_id"), "id")).alias("at"))
    cuts = cuts.select(F.col("source").alias("__source"), F.col("at.key").alias("__key"), F.col("at.id").alias("cut_id"), F.col("at.running").alias("reached"))
    plan = stored(budget.join(cuts, F.col("source").eqNullSafe(F.col("__source")), "left").select(
        "source", "source_size", "weighed", "target", "room", (F.col("room") - F.coalesce("reached", "before")).alias("gap"),
        F.when(F.col("prefix") < 0, F.lit(1 << BITS)).otherwise(F.coalesce("__key", F.shiftleft("prefix", BITS - 2 * STEP) - 1)).alias("cut_key"), "cut_id"))
    # one more document closes the gap where it can: the one whose size is nearest to it
    rest = by_source(open_rows, plan).filter(~in_sample() & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    extra = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "key", F.col("id").isNull().alias("null_id"), "id")).alias("at"))
    extra = extra.select(F.col("source").alias("__source"), F.col("at.key").alias("extra_key"), F.col("at.id").alias("extra_id"))
    plan = plan.join(extra, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source", "gap")
    return rows, stored(plan)


def in_sample() -> Column:
    """Whether a row fits its source's room and its key is not beyond the cut; null ids come last."""
    later = F.coalesce(F.col("id") > F.col("cut_id"), F.col("id").isNull() & F.col("cut_id").isNotNull())
    beyond = (F.col("key") > F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & later)
    return F.col("key").isNotNull() & ~beyond & (F.col("size") <= F.col("room"))


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join a table of one row per source, nulls included; adaptive execution splits a large source."""
    right = sources.withColumnRenamed("source", "__source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def expected_copies() -> list[Column]:
    """``whole`` copies and sampling ``key`` (null: nothing left to sample) from size, weight, lot and the source's numbers."""
    expected = F.when(F.col("weighed") > 0, F.least(F.col("target") * F.col("weight") / F.col("weighed"), F.lit(2.0))).otherwise(F.lit(0.0))
    whole = F.floor(expected)
    share = expected - whole
    odds = (F.col("lot") / (1 - F.col("lot"))) / (share / (1 - share))
    key = F.when(share > 0, F.least(F.floor(odds / (1 + odds) * float(1 << BITS)), F.lit((1 << BITS) - 1)))
    return [whole.cast("long").alias("whole"), key.alias("key")]


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``copies`` (0 to 2) to rows of id, source, weight, size and lot."""
    joined = by_source(rows, plan).select("*", *expected_copies())
    extra = (F.col("key") == F.col("extra_key")) & F.col("id").eqNullSafe(F.col("extra_id"))
    return joined.withColumn("copies", F.col("whole") + F.when(in_sample() | F.coalesce(extra, F.lit(False)), 1).otherwise(0))


def mixed(docs: DataFrame, weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The mix itself: every document as often as it is taken, all columns as they were. Documents without words follow their key alike."""
    _, plan = mix_plan(docs, weight_col, id_col, text_col, source_col, **targets)
    columns = docs.columns
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    packed = docs.select(F.struct(*columns).alias("__doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_of(text_col).alias("text"), weight.alias("weight"))
    lots = packed.select("__doc", "id", "source", "weight", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), _lots(packed).alias("lot"))
    taken = with_copies(lots, plan)
    return taken.select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Null texts have size 0; an empty table gives no rows; equal rows are taken alike."""
    rows, plan = mix_plan(table(spark, sf_dir, "documents"))
    return with_copies(rows, plan).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLE = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS lot
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0 * source_size / weight AS ratio, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS n FROM s
), p AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, 1.5 * sum(source_size) OVER () AS total
  FROM o
), l AS (SELECT ((total - capped) / open)::DOUBLE AS level FROM p WHERE (total - capped) / open <= ratio ORDER BY n LIMIT 1),
g AS (SELECT source, source_size, least(weight * level, 2.0 * source_size)::DOUBLE AS target FROM s, l),
e AS (
  SELECT d.*, source_size, target, least(target / source_size, 2.0) AS expected FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), k AS (
  SELECT *, floor(expected) AS whole, expected - floor(expected) AS share FROM e
), q AS (
  SELECT *, CASE WHEN share > 0 THEN (lot / (1 - lot)) / (share / (1 - share)) END AS odds FROM k
), r AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS room,
         CASE WHEN odds IS NOT NULL THEN floor(odds / (1 + odds) * 4503599627370496.0) END AS key FROM q
), c AS (
  SELECT *, sum(CASE WHEN key IS NULL OR size > room THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id) AS running FROM r
), b AS (SELECT source, any_value(room) - coalesce(max(running) FILTER (WHERE running <= room AND size <= room), 0) AS gap FROM c WHERE key IS NOT NULL GROUP BY source),
x AS (
  SELECT c.source, arg_min(doc_id, struct_pack(a := abs(size - gap), k := key, d := doc_id)) AS extra
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE key IS NOT NULL AND (running > room OR size > room) AND abs(size - gap) < gap GROUP BY c.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN key IS NOT NULL AND (running <= room AND size <= room OR doc_id IS NOT DISTINCT FROM extra) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c LEFT JOIN x ON c.source IS NOT DISTINCT FROM x.source"""
}

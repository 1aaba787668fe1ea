"""Queries for the incremental jobs, driven to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulegrain.plans.corpus import table
from rulegrain.plans.graph_queries import CLASSIFIED, modules_of, order_rules
from rulegrain.session import shared_folder
from rulegrain.streaming import incremental as I

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table, which is one file or a folder of files."""
    rows, place = table(spark, sf_dir, name), f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(rows.schema)
    if any(file.rsplit("/", 2)[1] == f"{name}.parquet" for file in rows.inputFiles()[:1]):
        return reader.parquet(place)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "event-windows")
    I.windowed_counts(_stream(spark, sf_dir, "events"), "ts", "event_type", out, f"{out}/state").awaitTermination()
    return I.current_counts(spark, out).select("window_start", F.col("kind").alias("event_type"), "n")


ORACLE["event_windows"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def _in_turn(spark: SparkSession, turns: list[DataFrame], name: str, start) -> None:
    """Bring the rows of each turn, then let the job of ``start`` take them as one batch and go on from its checkpoint."""
    source = shared_folder(spark, name)
    for rows in turns:
        rows.write.mode("append").parquet(source)
        start(I.read_stream(spark, source, rows.schema, ONE_BATCH)).awaitTermination()


ONE_BATCH = 2**31 - 1  # files of a turn


def _turned(spark: SparkSession, sf_dir: str) -> str:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    out = shared_folder(spark, "late-events")
    turns = [events.filter(F.pmod("event_id", F.lit(3)) == number) for number in range(3)]
    _in_turn(spark, turns, "events-in-turn", lambda stream: I.windowed_counts(stream, "ts", "event_type", out, f"{out}/state", "1 day", "2 days"))
    return out


@query
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three turns, each over the whole time: later turns bring late rows, which are counted apart."""
    out = _turned(spark, sf_dir)
    both = I.current_counts(spark, out).withColumn("late", F.lit(False)).unionByName(I.late_counts(spark, out).withColumn("late", F.lit(True)))
    return both.select("window_start", F.col("kind").alias("event_type"), "late", "n")


ORACLE["late_events"] = """WITH high AS (SELECT event_id % 3 AS turn, max(ts) AS high FROM events GROUP BY 1),
e AS (SELECT date_trunc('day', ts) AS window_start, event_type, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(high) FROM high h WHERE h.turn < event_id % 3) - INTERVAL 2 DAY, false) AS late FROM events)
SELECT CAST(window_start AS TIMESTAMP) AS window_start, event_type, late, count(*) AS n FROM e GROUP BY 1, 2, 3"""


@query
def classified_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the orders in three turns, each rule in two of them: every atom is classified once."""
    atoms = order_rules(spark, sf_dir)
    modules, out = modules_of(spark, sf_dir), shared_folder(spark, "classified-stream")
    turns = [atoms.filter((F.pmod("row_no", F.lit(3)) == number) | (F.pmod(F.col("row_no") + 1, F.lit(3)) == number)) for number in range(3)]
    _in_turn(spark, turns, "atoms-in-turn", lambda stream: I.classify_new_atoms(stream, modules, out, f"{out}/state"))
    return I.classified(spark, out).groupBy(F.array_join("label_paths", "|").alias("paths"), "rule_type").agg(F.count("*").alias("atoms"))


ORACLE["classified_stream"] = CLASSIFIED + """,
gathered AS (SELECT atom_id, string_agg(label_path, '|' ORDER BY r) AS paths FROM (SELECT atom_id, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS r FROM labels) JOIN modules USING (code) GROUP BY 1)
SELECT coalesce(paths, '待分类 > 待分类 > 待分类') AS paths, rule_type, count(*) AS atoms FROM atoms LEFT JOIN gathered USING (atom_id) GROUP BY 1, 2"""


@query
def documents_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = I.import_stream(_stream(spark, sf_dir, "documents"), "text")
    return _run(spark, hashed.select("sha1"), "documents-once")


ORACLE["documents_once"] = "SELECT DISTINCT sha1(text) AS sha1 FROM documents"

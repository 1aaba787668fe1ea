"""Incremental jobs: classify new atoms, import each artifact once, keep metrics current.

Results of a batch stand in folders that name the batch and are overwritten when it is run again, so a restart after a lost executor
or driver neither doubles nor loses any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rulegrain.functions.text import strip
from rulegrain.operators.lineage import content_hash
from rulegrain.operators.taxonomy import classify
from rulegrain.session import cut_lineage


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def _started(stream: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------------ new atoms
def classify_new_atoms(atoms: DataFrame, modules: DataFrame, output: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Classify atoms that have no stored result (S1); of rows with one id in a batch, one counts.

    ``output/ids`` keeps the ids that are done in hash buckets; a batch reads the buckets of its own ids and no results.
    ``output/results/batch_id=N`` holds what batch N classified.
    """
    spark = atoms.sparkSession
    kind = atoms.schema["atom_id"].dataType.simpleString()
    ledger, schema = f"{output}/ids", f"atom_id {kind}, bucket int, batch_id long"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket", "batch_id").parquet(ledger)  # so that it can be read from the start

    def write(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("atom_id"), F.lit(buckets)).cast("int")
        named = batch.filter(strip(F.col("atom_id").cast("string")) != "").withColumn("bucket", bucket)
        touched = [row["bucket"] for row in named.select("bucket").distinct().collect()]  # at most ``buckets``
        done = spark.read.schema(schema).parquet(ledger).filter(F.col("bucket").isin(touched) & (F.col("batch_id") != number))
        # known ids leave first, and both steps share one shuffle; the session of a stream plans without measured sizes, so another reads
        new = cut_lineage(named.join(done.select("atom_id"), "atom_id", "left_anti").dropDuplicates(["atom_id"]), spark)
        if number and new.isEmpty():  # batch 0 has left the columns of the results
            return
        classify(new.drop("bucket"), modules).write.mode("overwrite").parquet(f"{output}/results/batch_id={number}")
        old_mode = {"partitionOverwriteMode": "dynamic"}
        ids = new.select("atom_id", "bucket", F.lit(number).cast("long").alias("batch_id")).repartition("bucket")  # one file per bucket and batch
        ids.write.mode("overwrite").options(**old_mode).partitionBy("bucket", "batch_id").parquet(ledger)

    return _started(atoms, write, checkpoint, trigger)


def classified(spark: SparkSession, output: str) -> DataFrame:
    """All results of :func:`classify_new_atoms`."""
    return spark.read.parquet(f"{output}/results")


# ------------------------------------------------------------------ artifacts
def import_stream(artifacts: DataFrame, content: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each content once (S2): by hash, with bounded state when the rows carry an event time."""
    hashed = artifacts.withColumn("sha1", content_hash(content))
    if event_time is None:
        return hashed.dropDuplicates(["sha1"])
    return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sha1"])


# ------------------------------------------------------------------ metrics (S3)
_PARTS = "window_start timestamp, window_end timestamp, kind string, late boolean, n long, high timestamp, batch_id long"


def windowed_counts(events: DataFrame, time: str, kind: str, output: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Counts per event-time window and kind that keep current, with late rows counted apart (S3).

    The watermark of a batch is the latest time of the batches before it less ``delay``; a row whose window has ended by then is late: it is
    counted in :func:`late_counts` and changes no closed window. A batch is read once and leaves one row per window and kind; the only
    state is one mark per batch. Rows without a time are in no window; a null kind is a kind.
    """
    spark = events.sparkSession
    marks = "high timestamp, batch_id long"
    spark.createDataFrame([], marks).write.mode("append").partitionBy("batch_id").parquet(f"{output}/marks")

    def write(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema(marks).parquet(f"{output}/marks").filter(F.col("batch_id") < number)
        closed = earlier.agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("closed")).first()["closed"]
        rows = batch.filter(F.col(time).isNotNull()).groupBy(F.window(time, window).alias("w"), F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("n"), F.max(time).cast("timestamp").alias("high"))
        end = F.col("w.end").cast("timestamp")
        late = F.lit(False) if closed is None else end <= F.lit(closed)
        path = f"{output}/parts/batch_id={number}"
        rows.select(F.col("w.start").cast("timestamp").alias("window_start"), end.alias("window_end"), "kind", late.alias("late"), "n", "high").write.mode("overwrite").parquet(path)
        top = spark.read.schema(_PARTS).parquet(path).agg(F.max("high").alias("high"))
        top.write.mode("overwrite").parquet(f"{output}/marks/batch_id={number}")

    return _started(events, write, checkpoint, trigger)


def _parts(spark: SparkSession, output: str, late: bool) -> DataFrame:
    rows = spark.read.schema(_PARTS).parquet(f"{output}/parts").filter(F.col("late") == late)
    return rows.groupBy("window_start", "kind").agg(F.sum("n").alias("n"))


def current_counts(spark: SparkSession, output: str) -> DataFrame:
    return _parts(spark, output, False)


def late_counts(spark: SparkSession, output: str) -> DataFrame:
    return _parts(spark, output, True)

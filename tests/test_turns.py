"""Turns of a stream: written by many tasks, taken as one batch each; atoms that are done are not classified again."""

import os

from pyspark.sql import functions as F

from rulegrain.operators import taxonomy as X
from rulegrain.plans import stream_queries
from rulegrain.streaming import incremental as I


def test_a_turn_of_many_files_is_one_batch(spark, tmp_path):
    seen = {}

    def start(stream):
        def write(batch, number):
            seen[number] = (batch.count(), len(batch.select(F.input_file_name()).distinct().collect()))

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    rows = spark.range(90).repartition(3)
    stream_queries._in_turn(spark, [rows.filter(F.col("id") % 3 != number) for number in range(2)], "turns", start)
    assert seen == {0: (60, 3), 1: (60, 3)}


def test_a_batch_of_known_atoms_leaves_no_results(spark, tmp_path):
    modules = X.taxonomy_modules(spark.createDataFrame(
        [(1, "【S】", "【S】", "", ""), (2, "cat", "mod", "alpha", "")], "row_no int, category string, module string, projects string, remark string"))
    atoms = spark.createDataFrame([("a", "alpha"), ("b", "none")], "atom_id string, what string")
    out = f"{tmp_path}/out"
    stream_queries._in_turn(spark, [atoms.repartition(2), atoms], "known", lambda stream: I.classify_new_atoms(stream, modules, out, f"{out}/state"))
    assert I.classified(spark, out).count() == 2 and sorted(os.listdir(f"{out}/results")) == ["batch_id=0"]
    assert max(len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(f"{out}/ids")) == 1

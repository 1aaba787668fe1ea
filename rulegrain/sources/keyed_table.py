"""A stored table that batches are merged into by key: hash buckets, of which a merge rewrites only those it touches.

``path/data/v=N/bucket=B`` holds what the N-th merge wrote; ``path/live/v=N`` says which version of each bucket counts from then
on. The second is written last, so a merge that dies half-way leaves the table as it was, and running it again is safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulegrain.functions.text import strip
from rulegrain.session import cut_lineage


@dataclass(frozen=True)
class KeyedTable:
    """``keys`` name a row; of equal keys the row greatest by ``order`` stays, and a later merge wins over an earlier one."""

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int = 64

    def _live(self, spark: SparkSession) -> dict[int, int]:
        """Version of each bucket, at most ``buckets`` rows; empty before the first merge."""
        try:
            rows = spark.read.parquet(f"{self.path}/live")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return {}
        newest = rows.agg(F.max("v")).first()[0]
        return {row["bucket"]: row["version"] for row in rows.filter(F.col("v") == newest).collect()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession, live: dict[int, int]) -> DataFrame | None:
        """Rows of the live buckets given; only their folders are read."""
        versions: dict[int, list[int]] = {}
        for bucket, version in live.items():
            versions.setdefault(version, []).append(bucket)
        parts = [
            spark.read.option("basePath", f"{self.path}/data/v={version}").parquet(*[f"{self.path}/data/v={version}/bucket={bucket}" for bucket in sorted(held)])
            for version, held in sorted(versions.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("bucket") if parts else None

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The whole table, or None before the first merge."""
        return self._stored(spark, self._live(spark))

    def merge(self, batch: DataFrame) -> dict[str, int]:
        """Merge a batch: rows with a null or blank key are left out, new keys join, known ones are replaced as a whole.

        Returns the buckets rewritten and kept. Equal keys merge before the shuffle, so one key in a third of the rows is no burden.
        """
        spark = batch.sparkSession
        named = reduce(lambda a, b: a & b, [strip(F.col(key).cast("string")) != "" for key in self.keys])
        rest = [name for name in batch.columns if name not in self.keys]
        rank = F.struct(*[name for name in self.order if name in batch.columns] or rest or [F.lit(0)])
        grouped = batch.filter(named).groupBy(*self.keys)
        if len(rest) == 1 and tuple(rest) == self.order:  # nothing but what decides: a plain maximum, which Spark hashes and does not sort for
            picked = grouped.agg(F.max(rest[0]).alias(rest[0]))
        else:
            held = grouped.agg(F.max_by(F.struct(*rest), rank).alias("__row") if rest else F.lit(0).alias("__row"))
            picked = held.select(*self.keys, *[F.col(f"__row.{name}").alias(name) for name in rest])
        fresh = cut_lineage(picked.withColumn("bucket", self.bucket()))
        touched = [row["bucket"] for row in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        live = self._live(spark)
        if not touched:
            return {"rewritten": 0, "kept": len(live)}
        version = 1 + max(live.values(), default=0)
        old = self._stored(spark, {bucket: live[bucket] for bucket in touched if bucket in live})
        rows = fresh
        if old is not None:
            kept = old.withColumn("bucket", self.bucket()).join(fresh.select(*self.keys), list(self.keys), "left_anti")
            rows = kept.unionByName(fresh, allowMissingColumns=True)
        # one writer a bucket and part of it: large buckets are split by the files they fill
        rows.repartition("bucket").write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        now = {**live, **dict.fromkeys(touched, version)}
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/live/v={version}")
        return {"rewritten": len(touched), "kept": len(now) - len(touched)}


@dataclass(frozen=True)
class GraphStore:
    """Stored nodes by id and edges by source, target and type."""

    nodes: KeyedTable
    edges: KeyedTable

    @classmethod
    def at(cls, path: str, order: Sequence[str] = (), buckets: int = 64) -> GraphStore:
        return cls(KeyedTable(f"{path}/nodes", ("id",), tuple(order), buckets), KeyedTable(f"{path}/edges", ("source", "target", "type"), tuple(order), buckets))

    def merge(self, nodes: DataFrame, edges: DataFrame) -> dict[str, dict[str, int]]:
        """Upsert nodes, then the edges that link them."""
        return {"nodes": self.nodes.merge(nodes), "edges": self.edges.merge(edges)}

    def dangling(self, spark: SparkSession) -> DataFrame:
        """Edges with an end that is no stored node."""
        nodes, edges = self.nodes.read(spark).select("id"), self.edges.read(spark).select("source", "target", "type")
        known = lambda end: nodes.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
        # both sides are unique by key, so an edge stays one row
        ends = edges.join(known("source"), "source", "left").join(known("target"), "target", "left")
        return ends.filter(F.col("_source").isNull() | F.col("_target").isNull()).select("source", "target", "type")


def load_rule_graph(store: GraphStore, rules: DataFrame, alignments: DataFrame, atoms: DataFrame) -> dict[str, dict[str, int]]:
    """Load the graph of some documents: reference rules, clause segments, atoms and their links, upserted by id.

    Rows with a blank id are dropped, as are links with a blank end.
    """
    from rulegrain.operators.graph import rule_graph

    parts = rule_graph(rules, alignments, atoms)
    return store.merge(parts["nodes"], parts["edges"])

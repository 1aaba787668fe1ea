"""Approximate nearest neighbours: balanced posting lists, a graph of centroids, and distance-ratio pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulegrain.llm.common import stored, table

COPIES, STORE_RATIO = 3, 1.1  # lists that a boundary vector goes to: at most so many, within so much of its nearest
NEAR = 2  # lists of a query that are read first and set the score others must reach
PAIRS = 20_000  # vectors compared at once, and rows that leave a Python task at once: what a task holds does not grow with the lists


@dataclass
class Centroids:
    """Centroids, the graph over them, the longest norm, and the pruning ratios of queries and of boundary vectors."""

    points: np.ndarray
    graph: np.ndarray
    longest: float
    query_ratio: float
    store_ratio: float

    def lifted(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate makes the largest inner product the smallest distance; unit vectors stay as they are."""
        norms = np.linalg.norm(rows, axis=1)
        if query:
            return np.column_stack([rows * (self.longest / np.maximum(norms, 1e-300))[:, None], np.zeros(len(rows))])
        return np.column_stack([rows, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))])

    def nearest_lists(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that stored vectors go to, nearest first, and which of them are within the ratio."""
        squared = np.maximum((rows**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1) - 2 * rows @ self.points.T, 0)
        order = np.argsort(squared, axis=1)[:, :COPIES]
        far = np.take_along_axis(squared, order, axis=1)
        return order, far <= far[:, :1] * self.store_ratio**2

    def search(self, rows: np.ndarray, ratio: float, beam: int = 8) -> np.ndarray:
        """Squared distances (rows x lists) to the lists that the graph walk meets, infinite elsewhere.

        From fixed entries, a row's nearest known lists and all within ``ratio`` (1.2 at least) of the nearest
        are opened until none is left; only lists met on the way are measured.
        """
        count = len(self.points)
        far = np.full((len(rows), count), np.inf)
        opened = np.zeros_like(far, dtype=bool)
        entries = np.unique(np.linspace(0, count - 1, min(count, 16)).astype(int))
        far[:, entries] = ((rows[:, None] - self.points[entries]) ** 2).sum(axis=2)
        while True:
            nearest = far.min(axis=1)
            edge = np.partition(far, min(beam, count) - 1, axis=1)[:, min(beam, count) - 1]
            bound = np.where(np.isfinite(edge), np.maximum(edge, nearest * max(ratio, 1.2) ** 2), np.inf)
            ready = np.isfinite(far) & ~opened & (far <= bound[:, None])
            who, which = np.nonzero(ready)
            if not len(who):
                return far
            opened |= ready
            met = np.zeros_like(opened)
            met[who[:, None], self.graph[which]] = True
            who, which = np.nonzero(met & ~np.isfinite(far))
            for start in range(0, len(who), PAIRS):
                a, b = who[start:start + PAIRS], which[start:start + PAIRS]
                far[a, b] = ((rows[a] - self.points[b]) ** 2).sum(axis=1)

    def lists(self, rows: np.ndarray, ratio: float, most: int | None = None, holds: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) pairs within ``ratio`` of each row's nearest list, and the list's place by distance; with ``most``, its nearest so many.

        With ``holds`` (ids that each list is home of), the ratio counts from the list at which a row's nearest lists
        are home of ``least`` ids together, so a row beside a small list reads on; all lists if they never are.
        """
        found = []
        for start in range(0, len(rows), 512):
            some = rows[start:start + 512]
            far = self.search(some, ratio)
            home = far.argmin(axis=1)
            base = far.min(axis=1)
            if holds is not None:
                short = np.flatnonzero(holds[home] < least)
                for at in short:
                    far[at] = ((some[at] - self.points) ** 2).sum(axis=1)
                    order = np.argsort(far[at], kind="stable")
                    reached = np.flatnonzero(np.cumsum(holds[order]) >= least)
                    base[at] = far[at, order[reached[0]]] if len(reached) else np.inf
            keep = far <= (base * ratio**2)[:, None]
            if most is not None and far.shape[1] > most:
                keep &= far <= np.partition(far, most - 1, axis=1)[:, most - 1:most]
            who, which = np.nonzero(keep & np.isfinite(far))
            order = np.lexsort((far[who, which], who))
            who, which = who[order], which[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            found.append(np.column_stack([who + start, which, place]))
        all_of = np.concatenate(found) if found else np.empty((0, 3), dtype=int)
        return all_of[:, 0], all_of[:, 1], all_of[:, 2]


def balanced_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Lloyd rounds in which the emptiest lists move into lists of over twice the mean size."""
    random = np.random.default_rng(seed)
    points = sample[random.choice(len(sample), count, replace=False)].copy()
    for turn in range(rounds):
        distance = (points**2).sum(axis=1) - 2 * sample @ points.T
        nearest = distance.argmin(axis=1)
        sizes = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(points)
        np.add.at(sums, nearest, sample)
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
        if turn < rounds - 1:
            crowded = np.flatnonzero(sizes > 2 * len(sample) / count)
            for big, small in zip(crowded, np.argsort(sizes), strict=False):
                members = np.flatnonzero(nearest == big)
                points[small] = sample[random.choice(members)]
    return points


def fit(vectors: DataFrame, rows: int, sample: int = 20_000, most_lists: int = 2048, top: int = 20, reach: float = 0.94) -> Centroids | None:
    """Centroids from at most ``sample`` vectors (lowest id hashes), about one list per sqrt(rows).

    The query ratio is the smallest that reaches ``reach`` of the true neighbours of 200 sampled queries in the sample, each by the
    nearest of the lists it is stored in.
    """
    lot = F.xxhash64("vec_id", F.lit("fit"))
    found = vectors.select("embedding", "vec_id").orderBy(lot, "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(found):
        return None
    plain = np.unique(np.stack(list(found)).astype(np.float64), axis=0)
    longest = float(vectors.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0]) ** 0.5
    model = Centroids(np.empty((0, 0)), np.empty((0, 0), dtype=int), longest, 1.0, STORE_RATIO)
    lifted = model.lifted(plain, False)
    count = int(max(1, min(most_lists, round(rows**0.5), len(plain) // 4 or 1)))
    model.points = balanced_centroids(lifted, count)
    gaps = ((model.points[:, None] - model.points) ** 2).sum(axis=2) if count <= 512 else np.stack([((p - model.points) ** 2).sum(axis=1) for p in model.points])
    near = np.argsort(gaps, axis=1)[:, : min(count, 17)]
    far = np.random.default_rng(4).integers(0, count, (count, 4))  # a few long edges keep the graph in one piece
    ring = (np.arange(count)[:, None] + 1) % count
    model.graph = np.column_stack([near, far, ring])
    asked = np.random.default_rng(5).permutation(len(plain))[:200]
    queries = model.lifted(plain[asked], True)
    near_lists, within = model.nearest_lists(lifted)
    homes = near_lists[:, 0]
    to_lists = np.sqrt(np.maximum(((queries[:, None] - model.points) ** 2).sum(axis=2), 0))
    scores = plain[asked] @ plain.T
    best = np.argsort(-scores, axis=1)[:, : top + 1]
    order = np.argsort(to_lists, axis=1)
    held = np.cumsum(np.bincount(homes, minlength=count)[order] * (rows / len(plain)), axis=1) >= top + 1
    enough = np.where(held.any(axis=1), held.argmax(axis=1), count - 1)
    base = to_lists.min(axis=1)  # that of a query on its own centroid says nothing
    base = np.where(base > 1e-6 * longest, base, to_lists[np.arange(len(asked)), order[np.arange(len(asked)), enough]])
    reached = np.where(within[best], to_lists[np.arange(len(asked))[:, None, None], near_lists[best]], np.inf).min(axis=2)
    ratios = reached[:, 1:] / np.maximum(base, 1e-12)[:, None]  # the first is the query itself
    ratios = ratios if ratios.size else np.ones((1, 1))
    model.query_ratio = float(max(1.02, np.quantile(ratios, reach)))
    return model


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id whose vector is not null, not zero, finite throughout, and as long as most vectors are."""
    value = F.col(vector_col)
    fine = value.isNotNull() & F.col(id_col).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), value.alias("embedding"))
    common = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows.filter(F.size("embedding") == (common["width"] if common else 0))


def _parts(batch: pd.DataFrame, who: np.ndarray, added: dict[str, np.ndarray], fields: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of a batch by place, with further columns, ``PAIRS`` at a time: a vector is repeated for each of its lists."""
    for start in range(0, len(who), PAIRS):
        part = slice(start, start + PAIRS)
        yield batch.iloc[who[part]].assign(**{name: values[part] for name, values in added.items()})[fields]


def _packed_blocks(batches: Iterator[pa.RecordBatch], fields: list[str], alias: str) -> Iterator[pa.RecordBatch]:
    """One row for each (list, __block) of sorted rows, as bytes: keys, how many keys each entry has, floors, vectors.

    The key is the first field, one number or a list of numbers; a floor is read where there is a field of that name.
    """
    held: list[tuple[np.ndarray, ...]] = []
    at: tuple[int, int] | None = None

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return column.to_numpy(zero_copy_only=False), np.ones(len(column), dtype=np.int64)

    def block() -> pa.RecordBatch:
        parts = [np.concatenate(part) for part in zip(*held, strict=True)]
        arrays = [pa.array([at[0]], pa.int32()), *[pa.array([part.tobytes()], pa.binary()) for part in parts]]
        return pa.RecordBatch.from_arrays(arrays, names=["list", *[f"{alias}_{name}" for name in ("keys", "sizes", "floors", "vectors")]])

    for batch in batches:
        lists, numbers = (batch.column(place).to_numpy(zero_copy_only=False) for place in range(2))
        edges = np.flatnonzero((np.diff(lists) != 0) | (np.diff(numbers) != 0)) + 1
        for start, end in zip([0, *edges], [*edges, len(lists)], strict=True):
            if start == end:
                continue
            if held and at != (lists[start], numbers[start]):
                yield block()
                held = []
            at = (lists[start], numbers[start])
            piece = {name: batch.column(2 + place).slice(start, end - start) for place, name in enumerate(fields)}
            keys, sizes = flat(piece[fields[0]])
            floors = piece["floor"].to_numpy(zero_copy_only=False) if "floor" in piece else np.empty(0)
            held.append((keys.astype(np.int64), sizes, floors.astype(np.float64), flat(piece["embedding"])[0].astype(np.float64)))
    if held:
        yield block()


def nearest(vectors: DataFrame, queries: DataFrame | None = None, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` found of largest inner product, ties to the smaller id.

    Equal vectors are one entry with its ``top + 1`` smallest ids (more can never be among the nearest), so a
    vector that a third of the rows share is searched once. Entries go to at most ``COPIES`` lists within ``STORE_RATIO`` of their
    nearest; lists are cut into blocks by id hash, so none outgrows a task. Queries read the lists
    within the fitted ratio, counted from the list at which ``top + 1`` ids are reached, so each gets ``top`` rows or
    all there are. The ``NEAR`` nearest are read first; from the others only entries leave a task that reach the score of the
    ``top``-th found there. Centroids are at most 2,048 points and travel with the tasks. A row is never its own neighbour; null ids,
    null, zero and non-finite vectors and those of an odd length take no part; an empty table gives no rows.

    Blocks are cut from sorted rows as they stream by, and travel as flat bytes: a task holds one block of each side as arrays.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_col, vector_col))
    asked = rows.filter("vec_id % 20 = 0") if queries is None else usable(queries, id_col, vector_col)
    asked = asked.dropDuplicates(["vec_id", "embedding"])
    schema = "query_id long, rank int, vec_id long, score double"
    model = fit(rows, rows.count(), top=top)
    if model is None:
        return spark.createDataFrame([], schema)
    first = rows.distinct().withColumn("__at", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("__at") <= top + 1)
    entries = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                who, which, place = model.lists(model.lifted(np.stack(list(batch["embedding"])).astype(float), False), model.store_ratio, COPIES)
                yield from _parts(batch, who, {"list": which.astype(np.int32), "home": place == 0}, ["list", "home", "ids", "embedding"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                who, which, place = model.lists(model.lifted(np.stack(list(batch["embedding"])).astype(float), True), model.query_ratio, holds=holds, least=top + 1)
                yield from _parts(batch, who, {"list": which.astype(np.int32), "near": place < NEAR}, ["list", "near", "vec_id", "embedding"])

    posted = stored(entries.mapInPandas(post, "list int, home boolean, ids array<bigint>, embedding array<double>"))
    homes = posted.filter("home").select(F.explode("ids").alias("id"), "list").groupBy("id").agg(F.min("list").alias("list"))  # an id counts once
    holds = np.zeros(len(model.points), dtype=int)
    for row in homes.groupBy("list").count().collect():
        holds[row["list"]] = row["count"]
    probes = stored(asked.mapInPandas(probe, "list int, near boolean, vec_id long, embedding array<double>"))

    def blocks(df: DataFrame, key: str, fields: list[str], size: int, alias: str) -> DataFrame:
        counts = stored(df.groupBy("list").agg(F.ceil(F.count("*") / size).alias("__blocks")))
        split = df.join(counts, "list").withColumn("__block", F.pmod(F.xxhash64(key), F.col("__blocks"))).select("list", "__block", *fields)
        placed = split.repartition("list", "__block").sortWithinPartitions("list", "__block")
        schema = "list int, " + ", ".join(f"{alias}_{name} binary" for name in ("keys", "sizes", "floors", "vectors"))
        return placed.mapInArrow(lambda batches: _packed_blocks(batches, fields, alias), schema)

    packed = stored(blocks(posted, "ids", ["ids", "embedding"], block, "stored"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), dtype=kind)
                names, floors, flat, sizes = of("asked_keys", np.int64), of("asked_floors", np.float64), of("stored_keys", np.int64), of("stored_sizes", np.int64)
                q, v = of("asked_vectors", np.float64).reshape(len(names), -1), of("stored_vectors", np.float64).reshape(len(sizes), -1)

                def best_of(scores: np.ndarray, edges: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
                    """Row, query, id and exact score of the entries that reach the edge of their row, each id once a row."""
                    who, which = np.nonzero(scores[rows] >= edges[rows][:, None])
                    who = rows[who]
                    exact = np.empty(len(who))
                    for start in range(0, len(who), PAIRS):
                        part = slice(start, start + PAIRS)
                        exact[part] = np.sum(q[who[part]] * v[which[part]], axis=1)
                    each = sizes[which]
                    at = np.repeat(starts[which] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    out = pd.DataFrame({"row": np.repeat(who, each), "vec_id": flat[at], "score": np.repeat(exact, each)})
                    out["query_id"] = names[out["row"].to_numpy()]
                    out = out[out["query_id"] != out["vec_id"]].sort_values("score", ascending=False)
                    return out.drop_duplicates(["row", "vec_id"])

                starts = np.cumsum(sizes) - sizes
                scores = q @ v.T
                slack = 1e-9 * (1 + np.abs(scores).max(axis=1))
                width = min(len(v), top + 1)  # one entry can be the query itself
                edges = np.maximum(-np.partition(-scores, width - 1, axis=1)[:, width - 1], floors) - slack
                found = best_of(scores, edges, np.arange(len(q)))
                # one id with many vectors can fill the first look: then all that reach the floor are looked at
                some = np.bincount(found["row"].to_numpy(), minlength=len(q))
                short = np.flatnonzero((some < top) & ((scores >= (floors - slack)[:, None]).sum(axis=1) > (scores >= edges[:, None]).sum(axis=1)))
                if len(short):
                    found = pd.concat([found[~found["row"].isin(short)], best_of(scores, floors - slack, short)])
                found = found.sort_values(["score", "vec_id"], ascending=[False, True]).drop_duplicates(["query_id", "vec_id"])
                yield pa.RecordBatch.from_pandas(found.groupby("query_id", sort=False).head(top)[["query_id", "vec_id", "score"]], preserve_index=False)

    def searched(some: DataFrame) -> DataFrame:
        asked_blocks = blocks(some, "vec_id", ["vec_id", "floor", "embedding"], 1024, "asked")
        found = asked_blocks.join(packed, "list").drop("list").mapInArrow(score, "query_id long, vec_id long, score double")
        return stored(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = searched(probes.filter("near").withColumn("floor", F.lit(float("-inf"))))
    floors = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    others = probes.filter("NOT near").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = near.unionByName(searched(others)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLE: dict[str, str] = {}

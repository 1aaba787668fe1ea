"""What a task of the neighbour search holds is bounded: rows leave it in parts, blocks stream by as bytes."""

import numpy as np
import pandas as pd
import pyarrow as pa

from rulegrain.llm import neighbours as N


def _batch(lists, blocks, keys, vectors, kind=None):
    return pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(blocks, pa.int64()), pa.array(keys, kind), pa.array(vectors, pa.list_(pa.float64()))], names=["list", "__block", "ids", "embedding"])


def test_blocks_are_cut_where_the_key_changes_even_across_batches():
    batches = [_batch([1, 1, 2], [0, 0, 0], [[5, 6], [7], [8]], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]).slice(0), _batch([2, 2, 3], [0, 1, 1], [[9], [10], [11, 12]], [[7.0, 8.0], [9.0, 0.0], [1.5, 2.5]]), _batch([], [], [], [], pa.list_(pa.int64()))]
    got = [row for block in N._packed_blocks(iter(batches), ["ids", "embedding"], "stored") for row in block.to_pylist()]
    read = lambda row, name, kind: np.frombuffer(row[f"stored_{name}"], dtype=kind).tolist()
    assert [(row["list"], read(row, "keys", np.int64), read(row, "sizes", np.int64), read(row, "vectors", np.float64)) for row in got] == [
        (1, [5, 6, 7], [2, 1], [1.0, 2.0, 3.0, 4.0]), (2, [8, 9], [1, 1], [5.0, 6.0, 7.0, 8.0]), (2, [10], [1], [9.0, 0.0]), (3, [11, 12], [2], [1.5, 2.5])]


def test_a_row_of_many_lists_leaves_in_parts(monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 7)
    rows = pd.DataFrame({"vec_id": range(4)})
    who, lists = np.repeat(np.arange(4), 5), np.tile(np.arange(5), 4)
    parts = list(N._parts(rows, who, {"list": lists}, ["list", "vec_id"]))
    assert max(map(len, parts)) == 7
    whole = pd.concat(parts)
    assert whole["vec_id"].tolist() == who.tolist() and whole["list"].tolist() == lists.tolist()


def test_the_walk_measures_few_pairs_at_once(monkeypatch):
    random = np.random.default_rng(1)
    points = random.normal(size=(60, 4))
    model = N.Centroids(points, np.tile(np.arange(60), (60, 1)), 1.0, 1.0, 1.1)
    rows = random.normal(size=(50, 4))
    whole = model.search(rows, 1.5)
    monkeypatch.setattr(N, "PAIRS", 11)
    assert np.array_equal(whole, model.search(rows, 1.5))

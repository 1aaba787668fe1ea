"""Chunks matched in blocks get the segments that they get inside the rows; the segments are read once."""

import pytest

from rulegrain.operators import align as A

TEXTS = ["第一条 甲乙丙", "甲乙", "", "  ", "abc DEF abc", "abcdefabc", "bca", "😀甲", "甲乙丙丁戊己庚辛" * 40, "z", "甲乙丙", None]


@pytest.fixture
def sides(spark):
    chunks = spark.createDataFrame([(f"c{at}", doc, value) for at, value in enumerate([*TEXTS, "第2条 甲乙", "第2条 甲乙丙", "第9条 bca", "第3条", "二、甲"]) for doc in ("d", "e", "none")] + [("c0", "e", "bca"), ("x", None, "甲")],
                                   "chunk_id string, doc string, chunk string")
    segments = spark.createDataFrame([(f"s{at:02d}{doc}", doc, f"第{at % 4}条" if at % 5 else None, value, None if at == 7 else (at * 7) % 29 + (100 if doc == "e" else 0)) for at, value in enumerate(TEXTS[::-1] * 2) for doc in ("d", "e")] + [("n", None, "第2条", "甲乙", 1)],
                                     "segment_id string, doc string, ref string, text string, seg_ord int").repartition(3)
    return chunks, segments


@pytest.mark.parametrize("pack", [3, 256])
def test_blocks_equal_rows(sides, monkeypatch, pack):
    monkeypatch.setattr(A, "PACK_ROWS", pack)
    monkeypatch.setattr(A, "BLOCK_ROWS", 2)
    got = lambda: sorted(map(tuple, A.match_chunks(*sides).collect()), key=repr)
    blocks = got()
    monkeypatch.setattr(A, "BLOCK_LIST", {"max_rows": 0})
    rows = got()
    assert [(row[0], row[3]) for row in blocks] == [(row[0], row[3]) for row in rows]
    assert blocks == rows


def test_segments_are_read_once(sides):
    chunks, segments = sides
    plan = A.match_chunks(chunks, segments)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("seg_ord") and plan.lower().count("mapinarrow") == 1 and "contains(" not in plan.lower()

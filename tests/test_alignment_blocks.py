"""Scores in blocks equal scores inside the rows."""

import pytest

from rulegrain.operators import align as A

TEXTS = ["第一条 甲乙丙", "甲乙", "", "  ", "abc DEF abc", "abcdefabc", "bca", "😀甲", "甲乙丙丁戊己庚辛" * 40, "z", "甲乙丙"]


@pytest.fixture
def sides(spark):
    atoms = spark.createDataFrame([(f"a{at}", doc, value) for at, value in enumerate([*TEXTS, None]) for doc in ("d", "e")] + [("x", None, "甲乙")],
                                  "atom_id string, source_document string, content_original string").repartition(3)
    clauses = spark.createDataFrame([(at % 4, f"s{at:02d}", "r", doc, value) for at, value in enumerate(TEXTS[::-1]) for doc in ("d", None)],
                                    "clause_no int, segment_id string, rule_id string, document_name string, matched_segment_text string")
    return atoms, clauses


@pytest.mark.parametrize("pack", [3, 256])
def test_blocks_equal_rows(sides, monkeypatch, pack):
    atoms, clauses = sides
    segments = clauses.selectExpr("segment_id", "document_name AS doc", "matched_segment_text AS text")
    monkeypatch.setattr(A, "PACK_ROWS", pack)
    monkeypatch.setattr(A, "BLOCK_ROWS", 2)
    got = lambda: [sorted(map(tuple, rows.collect()), key=repr) for rows in (A.sample_links(atoms, clauses, 0.2), A.align_atoms(segments, atoms, 0.2))]
    blocks = got()
    monkeypatch.setattr(A, "BLOCK_LIST", {"max_rows": 0})
    assert blocks == got() and all(blocks)

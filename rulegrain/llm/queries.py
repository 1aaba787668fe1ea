"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from rulegrain.llm import bpe, exact_dedup, filter_audit, mixing, near_dedup, neighbours, quality, secrets, sharding, simhash, substring_dedup, token_alignment, toxicity

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (toxicity, exact_dedup, mixing, bpe, secrets, substring_dedup, neighbours, sharding, near_dedup, quality, token_alignment, filter_audit, simhash):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)

"""Clause alignment: which rule text belongs to which clause, by character overlap.

One side is always a curated list (clauses, citations). It travels to the large side, whose rows
score it in place: only results leave a task, and a document with very many rules stays spread over
its partitions. A list within a checked size is scored a block of rows at a time, as products of
character counts; a larger one is packed into bounded arrays per document. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulegrain.functions import vocab as V
from rulegrain.functions.text import article_hint, comparison_form, infer_rule_type, overlap_score, text, words_in
from rulegrain.operators.scale import broadcast_if_small, number_rows, size_checked, spread_join, top_rows

PACK_ROWS = 256
BLOCK_ROWS = 1024
BLOCK_CHARACTERS = 1_000_000
BLOCK_LIST = {"max_rows": 10_000, "max_bytes": 8 * 1024 * 1024}  # a task holds the letter counts of the whole list
THRESHOLD = 0.45


class _Pack:
    """Up to ``PACK_ROWS`` curated texts, compared with many texts at once."""

    def __init__(self, texts: list[str]):
        import ahocorasick

        self.size, self.lengths = len(texts), np.array([len(value) for value in texts])
        self.texts, self.joined, self.longest = texts, "\n".join(texts), max(map(len, texts))  # a normal form has no line ends
        letters = np.unique(self._codes(texts))
        self.letters = len(letters)
        self.place = np.full(int(letters.max(initial=0)) + 2, self.letters, dtype=np.int32)
        self.place[letters] = np.arange(self.letters)
        self.counts = self._counted(texts)
        places: dict[str, list[int]] = {}
        for at, value in enumerate(texts):
            places.setdefault(value, []).append(at)
        self.blank = places.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for value, held in places.items():
            self.automaton.add_word(value, held)
        if places:
            self.automaton.make_automaton()

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)

    def _counted(self, texts: list[str]) -> np.ndarray:
        """How often each text has each letter of the pack; letters the pack lacks are left out."""
        wide = self.letters + 1
        row = np.repeat(np.arange(len(texts)), [len(value) for value in texts])
        found = np.bincount(row * wide + self.place[np.minimum(self._codes(texts), len(self.place) - 1)], minlength=len(texts) * wide)
        return found.reshape(len(texts), wide)[:, : self.letters].astype(np.float64)

    def inside(self, texts: list[str]) -> np.ndarray:
        """Where one of the two texts contains the other."""
        out = np.zeros((len(texts), self.size), dtype=bool)
        out[:, self.blank] = True
        for row, value in enumerate(texts):
            if len(self.automaton):
                for _, held in self.automaton.iter(value):
                    out[row, held] = True
            if len(value) <= self.longest and value in self.joined:
                out[row] |= [value in other for other in self.texts]
        return out

    def scores(self, texts: list[str], inside: np.ndarray, text_left: bool) -> np.ndarray:
        """:func:`overlap_score` of each text with each of the pack, the text or the pack's as the left one."""
        counts, lengths = self._counted(texts), np.array([len(value) for value in texts])
        if text_left:
            shared, left = counts @ (self.counts > 0).T.astype(np.float64), lengths[:, None]
        else:
            shared, left = self._shared(counts), self.lengths[None, :]
        score = np.minimum(1.0, shared / np.maximum(left, 1) * 0.8 + np.where(inside, 0.2, 0.0))
        return np.where((lengths[:, None] == 0) | (self.lengths[None, :] == 0), 0.0, score)


    def _shared(self, counts: np.ndarray) -> np.ndarray:
        """How many letters of each of the pack's texts a text with these letter counts has."""
        return (counts > 0).astype(np.float64) @ self.counts.T

    def scores_to_beat(self, texts: list[str], floors: np.ndarray, strict: np.ndarray) -> np.ndarray:
        """:func:`overlap_score` of each of the pack, as the left one, with each text: exact where it reaches the floor of its column.

        Where ``strict`` it must exceed the floor; elsewhere a score may lack the bonus for containment. Texts are searched for
        containment only where the bonus would matter and lengths and letters allow it.
        """
        counts, lengths = self._counted(texts), np.array([len(value) for value in texts])
        shared = self._shared(counts)
        share = shared / np.maximum(self.lengths, 1)[None, :] * 0.8
        most = np.minimum(1.0, share + 0.2)
        able = ((shared == self.lengths[None, :]) | (lengths[:, None] <= self.lengths[None, :])) & np.where(strict[None, :], most > floors[None, :], most >= floors[None, :])
        inside = np.zeros(share.shape, dtype=bool)
        rows = np.nonzero(able.any(axis=1))[0]
        if len(rows):
            inside[rows] = self.inside([texts[at] for at in rows])
        score = np.where(inside, most, np.minimum(1.0, share))
        return np.where((lengths[:, None] == 0) | (self.lengths[None, :] == 0), 0.0, score)


def _listed(curated: DataFrame, doc: str, norm: str, fields: list[str]) -> list[tuple] | None:
    """(document, normal form, fields) of the curated rows in order of the fields, or None beyond ``BLOCK_LIST``."""
    rows = curated.filter(F.col(doc).isNotNull()).select(doc, norm, *fields)
    order = lambda row: tuple((value is not None, value) for value in (*row[2:], *row[:2]))
    return sorted((tuple(row) for row in rows.collect()), key=order) if size_checked(rows, **BLOCK_LIST) else None


def _scored_in_blocks(
    many: DataFrame, listed: list[tuple], row_id: str, doc: str, norm: str, kinds: str, choose: Callable[[_Pack, list[str], list[tuple]], tuple[np.ndarray, ...]],
) -> DataFrame:
    """(row id, curated fields, what ``choose`` finds) for each pair that ``choose`` picks.

    ``choose`` gets a pack, texts and the pack's curated rows; it returns row places, pack places and further columns, whose types ``kinds`` names.
    """
    rows = many.select(row_id, doc, norm)
    id_kind = rows.schema[row_id].dataType.simpleString()
    schema = f"{row_id} {id_kind}, _at int, {kinds}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[str, list[tuple[_Pack, int, list[tuple]]]] = {}

        def packs_of(name: str):
            if name not in packs:
                places = [at for at, row in enumerate(listed) if row[0] == name]
                packs[name] = [
                    (_Pack([listed[at][1] for at in part]), np.array(part, dtype=np.int32), [listed[at] for at in part])
                    for part in (places[start : start + PACK_ROWS] for start in range(0, len(places), PACK_ROWS))]
            return packs[name]

        for batch in batches:
            ids, names, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            groups: dict[str, list[int]] = {}
            for at, name in enumerate(names):
                groups.setdefault(name, []).append(at)
            for name, held in groups.items():
                for block in _blocks(held, texts):
                    mine = [texts[at] for at in block]
                    for pack, places, known in packs_of(name):
                        row, place, *values = choose(pack, mine, known)
                        if len(row):
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array(np.array(block)[row])), pa.array(places[place]), *[pa.array(value) for value in values]],
                                names=[row_id, "_at", *[kind.split()[0] for kind in kinds.split(", ")]])

    return rows.mapInArrow(run, schema)


def _best_in_blocks(refs: DataFrame, listed: list[tuple]) -> DataFrame:
    """(_at, hit, score, seg_ord, segment_id, ref): the best segment of each listed (document, normal form, chunk id, wanted) that a task met.

    A chunk with a wanted number has a second row (``hit``) for the best of the segments that carry it. Ties go to the lesser ``seg_ord``.
    """
    names = ["seg_ord", "segment_id", "ref"]
    rows = refs.select("source_document", "segment_norm", *names)
    schema = "_at int, hit boolean, score double, " + ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in names)
    kinds = [(name, rows.schema[name].dataType) for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        packs: dict[str, list[tuple[_Pack, list[int], dict[int, dict[str, list[int]]]]]] = {}
        best: dict[tuple[int, bool], tuple] = {}  # (place, hit): score, order, segment

        def packs_of(name: str):
            if name not in packs:
                places = [at for at, row in enumerate(listed) if row[0] == name]
                packs[name] = []
                for part in (places[start : start + PACK_ROWS] for start in range(0, len(places), PACK_ROWS)):
                    wanted: dict[int, dict[str, list[int]]] = {}  # by length, then by text
                    for column, at in enumerate(part):
                        if listed[at][3] is not None:
                            wanted.setdefault(len(listed[at][3]), {}).setdefault(listed[at][3], []).append(column)
                    packs[name].append((_Pack([listed[at][1] for at in part]), part, wanted))
            return packs[name]

        def offer(key: tuple[int, bool], score: float, row: tuple) -> None:
            if key not in best or (-score, row[0]) < (-best[key][0], best[key][1]):
                best[key] = (score, *row)

        for batch in batches:
            docs, texts, orders, ids, numbers = (batch.column(at).to_pylist() for at in range(5))
            groups: dict[str, list[int]] = {}
            for at, name in enumerate(docs):
                groups.setdefault(name, []).append(at)
            place = lambda at: (orders[at] is None, 0 if orders[at] is None else orders[at])
            for name, held in groups.items():
                for block in _blocks(held, texts) if packs_of(name) else ():
                    block = sorted(block, key=place)  # the first of equal scores is the one with the least order
                    mine = [texts[at] for at in block]
                    for pack, places, wanted in packs_of(name):
                        floors = np.array([best.get((at, False), (-1.0,))[0] for at in places])
                        strict = np.array([(at, False) in best and best[at, False][1] < place(block[0]) for at in places])
                        carrying: dict[int, list[int]] = {}
                        for length, known in wanted.items():
                            for row, at in enumerate(block):
                                for column in known.get(numbers[at][:length], ()) if numbers[at] is not None else ():
                                    carrying.setdefault(column, []).append(row)
                        for column in carrying:
                            floors[column] = min(floors[column], best.get((places[column], True), (-1.0,))[0])
                            strict[column] = False
                        scores = pack.scores_to_beat(mine, floors, strict)
                        top = scores.argmax(axis=0)
                        for column in np.nonzero(scores[top, np.arange(pack.size)] >= floors)[0].tolist():
                            at = block[top[column]]
                            offer((places[column], False), float(scores[top[column], column]), (place(at), orders[at], ids[at], numbers[at]))
                        for column, some in carrying.items():
                            row = some[int(scores[some, column].argmax())]
                            at = block[row]
                            offer((places[column], True), float(scores[row, column]), (place(at), orders[at], ids[at], numbers[at]))
        if best:
            found = [(*key, row[0], *row[2:]) for key, row in best.items()]
            columns = list(zip(*found, strict=True))
            arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.float64())]
            arrays += [pa.array(values, to_arrow_type(kind)) for values, (_, kind) in zip(columns[3:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_at", "hit", "score", *names])

    return rows.mapInArrow(run, schema)


def _blocks(held: list[int], texts: list[str]) -> Iterator[list[int]]:
    """The rows in blocks of bounded count and length."""
    block, size = [], 0
    for at in held:
        if block and (len(block) >= BLOCK_ROWS or size + len(texts[at]) > BLOCK_CHARACTERS):
            yield block
            block, size = [], 0
        block.append(at)
        size += len(texts[at])
    if block:
        yield block


def _named(found: DataFrame, listed: list[tuple], curated: DataFrame, fields: list[str]) -> DataFrame:
    """Curated fields in place of a place in the list."""
    schema = "_at int, " + ", ".join(f"{name} {curated.schema[name].dataType.simpleString()}" for name in fields)
    known = found.sparkSession.createDataFrame([(at, *row[2:]) for at, row in enumerate(listed)], schema)
    return found.join(F.broadcast(known), "_at").drop("_at")  # size checked


def _packed(curated: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """Curated rows of each document in arrays of about ``PACK_ROWS`` members."""
    sizes = curated.groupBy(doc).agg(F.ceil(F.count("*") / PACK_ROWS).cast("int").alias("_packs"))
    placed = curated.join(sizes, doc).withColumn("_pack", F.pmod(F.xxhash64(*fields), F.col("_packs")))
    return placed.groupBy(doc, "_pack").agg(F.collect_list(F.struct(*fields)).alias("pack")).select(F.col(doc).alias("_doc"), "pack")


def _meet(many: DataFrame, doc: str, row_id: str, packs: DataFrame) -> DataFrame:
    keyed = many.withColumn("_doc", F.col(doc))
    if size_checked(packs):
        return keyed.join(F.broadcast(packs), "_doc")
    return spread_join(keyed, packs, ["_doc"], [row_id])


def sample_links(atoms: DataFrame, clauses: DataFrame, threshold: float = THRESHOLD, top: int = 3) -> DataFrame:
    """Best clauses of each atom in its document (K5).

    ``clauses`` has segment_id, rule_id, document_name, matched_segment_text, clause_no. Scores use
    the atom as left text.
    """
    ready = clauses.withColumn("norm", comparison_form("matched_segment_text"))
    left = atoms.filter((text("source_document") != "") & (text("content_original") != "")).select(
        "atom_id", "source_document", comparison_form("content_original").alias("content_norm"))
    fields = ["clause_no", "segment_id", "rule_id"]
    listed = _listed(ready, "document_name", "norm", fields)
    if listed is not None:
        # the list is in order of clause number, which settles ties
        def best_of(pack: _Pack, texts: list[str], known: list[tuple]) -> tuple[np.ndarray, ...]:
            scores = pack.scores(texts, pack.inside(texts), True)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
            kept = np.take_along_axis(scores, order, axis=1)
            row, at = np.nonzero(kept >= threshold)
            return row, order[row, at], kept[row, at]

        rows = _named(_scored_in_blocks(left, listed, "atom_id", "source_document", "content_norm", "score double", best_of), listed, ready, fields)
        best = top_rows(rows, ["atom_id"], [F.desc("score"), F.col("clause_no"), F.col("segment_id"), F.col("rule_id")], top)
        return best.select("atom_id", "rule_id", "segment_id", F.round("score", 4).alias("score"), "rank")
    packs = _packed(ready, "document_name", ["clause_no", "segment_id", "rule_id", "norm"])
    met = _meet(left, "source_document", "atom_id", packs)
    scored = F.transform("pack", lambda clause: F.struct(
        overlap_score(F.col("content_norm"), clause["norm"], normalised=True).alias("score"), clause["clause_no"].alias("clause_no"),
        clause["segment_id"].alias("segment_id"), clause["rule_id"].alias("rule_id")))
    good = F.filter(scored, lambda item: item["score"] >= threshold)
    rows = met.select("atom_id", F.explode(good).alias("s")).select("atom_id", "s.*")
    best = top_rows(rows, ["atom_id"], [F.desc("score"), F.col("clause_no"), F.col("segment_id"), F.col("rule_id")], top)
    return best.select("atom_id", "rule_id", "segment_id", F.round("score", 4).alias("score"), "rank")


def align_atoms(segments: DataFrame, atoms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Atoms of each clause segment (K3): containing or contained texts where there are any, else close ones.

    ``segments`` has segment_id, doc, text. Scores use the segment as left text.
    """
    ready = segments.withColumn("norm", comparison_form("text"))
    right = atoms.select("atom_id", "source_document", comparison_form("content_original").alias("content_norm"))
    listed = _listed(ready, "doc", "norm", ["segment_id"])
    if listed is not None:
        def hits_of(inside: np.ndarray, texts: list[str]) -> np.ndarray:
            return inside & np.array([value != "" for value in texts])[:, None]

        def met_places(pack: _Pack, texts: list[str], known: list[tuple]) -> tuple[np.ndarray, ...]:
            places = np.nonzero(hits_of(pack.inside(texts), texts).any(axis=0))[0]
            return np.zeros(len(places), dtype=int), places, np.ones(len(places), dtype=bool)

        met = _scored_in_blocks(right, listed, "atom_id", "source_document", "content_norm", "hit boolean", met_places)
        with_hits = {listed[row["_at"]][2] for row in met.select("_at").distinct().collect()}  # at most the curated rows

        def useful_of(pack: _Pack, texts: list[str], known: list[tuple]) -> tuple[np.ndarray, ...]:
            inside = pack.inside(texts)
            hit, scores = hits_of(inside, texts), pack.scores(texts, inside, False)
            lonely = np.array([row[2] not in with_hits for row in known])
            row, at = np.nonzero(hit | (lonely[None, :] & (scores >= threshold)))
            return row, at, scores[row, at]

        rows = _scored_in_blocks(right, listed, "atom_id", "source_document", "content_norm", "score double", useful_of)
        return _named(rows, listed, ready, ["segment_id"]).select("segment_id", "atom_id", "score")
    packs = _packed(ready, "doc", ["segment_id", "norm"])
    met = _meet(right, "source_document", "atom_id", packs)
    body = F.col("content_norm")
    scored = F.transform("pack", lambda segment: F.struct(
        segment["segment_id"].alias("segment_id"),
        ((body != "") & (F.contains(segment["norm"], body) | F.contains(body, segment["norm"]))).alias("hit"),
        overlap_score(segment["norm"], body, normalised=True).alias("score")))
    useful = F.filter(scored, lambda item: item["hit"] | (item["score"] >= threshold))
    rows = met.select("atom_id", F.explode(useful).alias("s")).select("atom_id", "s.*")
    with_hits = rows.filter("hit").select("segment_id").distinct().withColumn("has_hit", F.lit(True))
    kept = rows.join(broadcast_if_small(with_hits), "segment_id", "left")
    return kept.filter(F.col("hit") | F.col("has_hit").isNull()).select("segment_id", "atom_id", "score")


def match_chunks(chunks: DataFrame, segments: DataFrame, prefix: str = V.FIRST_APPENDIX) -> DataFrame:
    """Best segment of each citation chunk in its document (K2).

    A leading article or item number restricts the segments when any carries it. ``chunks`` has
    chunk_id, doc, chunk; ``segments`` has doc, segment_id, ref, text, seg_ord. Ties go to the
    earlier segment. Candidates merge map-side: one row per chunk and map task. A list of chunks within ``BLOCK_LIST`` is scored
    in one pass over the segments, which looks for the numbers as well.
    """
    hint = article_hint("chunk")
    wanted = F.when(F.startswith(hint, F.lit("第")), hint).otherwise(F.concat(F.lit(f"{prefix}-"), hint))
    ready = chunks.select("chunk_id", "doc", comparison_form("chunk").alias("norm"), wanted.alias("wanted"))
    refs = segments.select(F.col("doc").alias("source_document"), "segment_id", "ref", "seg_ord", comparison_form("text").alias("segment_norm"))
    listed = _listed(ready, "doc", "norm", ["chunk_id", "wanted"])
    if listed is not None:
        ordered = F.struct("hit", "score", -F.col("seg_ord"))
        each = _best_in_blocks(refs, listed).groupBy("_at").agg(F.max_by(F.struct("score", "seg_ord", "segment_id", "ref"), ordered).alias("s")).select("_at", "s.*")
        rows = _named(each, listed, ready, ["chunk_id", "wanted"])
        return _best_of_chunks(rows)
    starts = ready.filter(F.col("wanted").isNotNull())
    hinted = refs.join(
        broadcast_if_small(starts.select(F.col("doc").alias("source_document"), "wanted").distinct()), "source_document"
    ).filter(F.startswith("ref", F.col("wanted"))).select(F.col("source_document").alias("doc"), "wanted").distinct().withColumn("found", F.lit(True))
    marked = ready.join(hinted, ["doc", "wanted"], "left").withColumn("wanted", F.when(F.col("found"), F.col("wanted"))).drop("found")
    packs = _packed(marked, "doc", ["chunk_id", "norm", "wanted"])
    met = _meet(refs, "source_document", "segment_id", packs)
    able = F.filter("pack", lambda chunk: chunk["wanted"].isNull() | F.startswith(F.col("ref"), chunk["wanted"]))
    scored = F.transform(able, lambda chunk: F.struct(
        chunk["chunk_id"].alias("chunk_id"), overlap_score(chunk["norm"], F.col("segment_norm"), normalised=True).alias("score")))
    rows = met.select("segment_id", "ref", "seg_ord", F.explode(scored).alias("s")).select("segment_id", "ref", "seg_ord", "s.*")
    return _best_of_chunks(rows)


def _best_of_chunks(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("chunk_id").agg(
        F.max(F.struct("score", -F.col("seg_ord"))).alias("top"),
        F.max_by(F.struct("segment_id", "ref"), F.struct(F.col("score"), -F.col("seg_ord"))).alias("segment"),
    )
    return best.select("chunk_id", "segment.segment_id", "segment.ref", F.round("top.score", 4).alias("match_score"))


def build_catalog(
    rules: DataFrame, citations: DataFrame, manual_refs: DataFrame, segments: DataFrame, atoms: DataFrame,
    entity_terms: list[str] = V.RULE_ENTITY_TERMS,
) -> dict[str, DataFrame]:
    """Rule catalog, clause alignments and atom subset (K4).

    ``rules``: rule_id, sequence, expert_rule, check_type. ``citations``: rule_id, doc, doc_no, chunk_no,
    chunk (already split). ``manual_refs``: rule_id, doc, doc_no, ref. Manual references replace the
    citations of their rule and document. A segment without any atom gets a fallback atom.
    """
    blocks = segments.filter(F.col("type").isin("article_block", "appendix_item"))
    by_hand = manual_refs.join(blocks, ["doc", "ref"]).select(
        "rule_id", "doc", "doc_no", F.col("seg_ord").alias("chunk_no"), F.col("text").alias("chunk"), "segment_id", F.lit(1.0).alias("match_score"))
    rest = citations.join(by_hand.select("rule_id", "doc").distinct(), ["rule_id", "doc"], "left_anti").withColumn(
        "chunk_id", F.concat_ws(":", "rule_id", "doc", F.col("chunk_no").cast("string")))
    matched = match_chunks(rest.select("chunk_id", "doc", "chunk"), segments)
    cited = rest.join(matched, "chunk_id").select("rule_id", "doc", "doc_no", "chunk_no", "chunk", "segment_id", "match_score")
    found = by_hand.withColumn("chunk_no", F.col("chunk_no").cast("int")).unionByName(cited.withColumn("chunk_no", F.col("chunk_no").cast("int")))
    pairs = found.join(segments.select("segment_id", "ref", "type", "text"), "segment_id").join(rules.select("rule_id", "sequence", "check_type"), "rule_id")
    used = segments.join(found.select("segment_id").distinct(), "segment_id", "left_semi")
    links = align_atoms(used, atoms)
    listed = links.groupBy("segment_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "atom_id"))), lambda item: item["atom_id"]).alias("atom_ids"))
    joined = pairs.join(listed, "segment_id", "left")
    lonely = number_rows(joined.filter(F.col("atom_ids").isNull()), ["sequence", "doc_no", "chunk_no", "segment_id"], "fallback_no")
    lonely = lonely.withColumn("atom_id", F.format_string("REF-ATOM-%03d", "fallback_no"))
    fallback = lonely.select(
        "atom_id", infer_rule_type("text").alias("rule_type"), F.col("doc").alias("source_document"), F.col("ref").alias("article_reference"),
        F.lit("").alias("who"), F.lit("").alias("what"), F.col("text").alias("how"), F.col("text").alias("content_original"), "rule_id")
    full = joined.filter(F.col("atom_ids").isNotNull()).unionByName(lonely.withColumn("atom_ids", F.array("atom_id")).drop("atom_id", "fallback_no"))
    alignments = full.select(
        "rule_id", "sequence", "check_type", F.col("doc").alias("document_name"), F.col("chunk").alias("source_chunk"), F.col("segment_id").alias("matched_segment_id"),
        F.col("ref").alias("matched_segment_ref"), F.col("type").alias("matched_segment_type"), F.col("text").alias("matched_segment_text"), "match_score",
        F.col("atom_ids").alias("aligned_atom_ids"))
    linked = full.select("rule_id", F.explode("atom_ids").alias("atom_id")).distinct()
    spoken = full.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.concat_ws("\n", "chunk", "text"))).alias("texts"))
    catalog = rules.join(linked.groupBy("rule_id").agg(F.array_sort(F.collect_set("atom_id")).alias("linked_atom_ids")), "rule_id", "left").join(spoken, "rule_id", "left")
    merged = F.concat_ws("\n", F.col("expert_rule"), F.array_join(F.coalesce("texts", F.array().cast("array<string>")), "\n"))
    catalog = catalog.withColumn("entities", words_in(merged, entity_terms)).drop("texts")
    back = linked.groupBy("atom_id").agg(F.array_sort(F.collect_set("rule_id")).alias("linked_rule_ids"))
    picked = atoms.join(broadcast_if_small(back), "atom_id").select("atom_id", "rule_type", "source_document", "article_reference", "content_original", "linked_rule_ids")
    subset = picked.unionByName(fallback.withColumn("linked_rule_ids", F.array("rule_id")).select(picked.columns))
    return {"rules": catalog.orderBy("sequence"), "alignments": alignments, "atoms": subset}


def resolve_documents(names: DataFrame, documents: DataFrame, least: int = 4) -> DataFrame:
    """Library document of each cited name: most containment and shared characters, a score of at least ``least``, ties to the lesser name.

    A score is the number of distinct characters both names have, and the length of a name that stands inside the other. Names that
    share ``least`` characters share one among all but the ``least - 1`` commonest of either, so only these rarer ones are join keys;
    a name of fewer distinct characters can only score by standing inside the other, and meets names that hold its rarest one.
    """
    from rulegrain.functions.text import document_name_form

    def ready(rows: DataFrame, name: str) -> DataFrame:
        form = document_name_form(name)
        letters = F.array_distinct(F.filter(F.split(form, ""), lambda letter: letter != ""))
        return rows.filter(F.col(name).isNotNull()).select(F.col(name).alias("name"), form.alias("form"), letters.alias("letters")).distinct()

    cited, library = ready(names, "source_document"), ready(documents, "document")
    counted = cited.unionByName(library).select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("seen"))

    def keyed(rows: DataFrame) -> DataFrame:
        """Join keys of a name: (letter, use) rows; use 0 joins 0, 1 (the rarest of a short name) joins 2 (any of the other)."""
        ranked = rows.select("name", F.explode("letters").alias("letter")).join(counted, "letter")
        ordered = ranked.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("seen", "letter"))), lambda item: item["letter"]).alias("rare"))
        key = lambda use: lambda letter: F.struct(letter.alias("letter"), F.lit(use).alias("use"))
        uses = F.concat(
            F.transform(F.slice("rare", 1, F.greatest(F.size("rare") - (least - 1), F.lit(0))), key(0)),
            F.when(F.size("rare") < least, F.transform(F.slice("rare", 1, 1), key(1))).otherwise(F.array().cast("array<struct<letter:string,use:int>>")),
            F.transform("rare", key(2)))
        return ordered.select("name", F.explode(uses).alias("k")).select("name", "k.*")

    mine, theirs = keyed(cited), keyed(library)
    met = lambda left, right: mine.filter(F.col("use") == left).select(F.col("name").alias("source_document"), "letter").join(
        theirs.filter(F.col("use") == right).select(F.col("name").alias("document"), "letter"), "letter")
    pairs = met(0, 0).unionByName(met(1, 2)).unionByName(met(2, 1)).select("source_document", "document").distinct()
    side = lambda rows, name, tag: rows.select(F.col("name").alias(name), F.col("form").alias(f"{tag}_form"), F.col("letters").alias(f"{tag}_letters"))
    rows = pairs.join(side(cited, "source_document", "a"), "source_document").join(side(library, "document", "b"), "document")
    inside = lambda small, large: F.when((F.col(small) != "") & F.contains(F.col(large), F.col(small)), F.length(small)).otherwise(0)
    score = inside("a_form", "b_form") + inside("b_form", "a_form") + F.size(F.array_intersect("a_letters", "b_letters"))
    scored = rows.select("source_document", "document", score.alias("score")).filter(F.col("score") >= least)
    return top_rows(scored, ["source_document"], [F.desc("score"), F.col("document")], 1).select("source_document", "document", "score")

"""Byte-level BPE by a pair occurrence index, and its decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rulegrain.llm.common import table, text_of

#: Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BLOCK = 250_000  # characters cut at once
_REMEMBERED = 32_000_000  # bytes of memory, by estimate, of the pieces that a task remembers


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: visible Latin-1 bytes for themselves, the rest from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {byte: chr(byte) for byte in visible}
    hidden = (byte for byte in range(256) if byte not in letters)
    letters.update((byte, chr(256 + at)) for at, byte in enumerate(hidden))
    return [letters[byte] for byte in range(256)]


class Vocabulary:
    """Ids, merge ranks and bytes of a byte-level BPE file in the tokenizers JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.byte_ids = np.array([ids[letter] for letter in letters], dtype=np.int64)
        self.bytes_of = {at: bytes(byte_of[letter] for letter in piece) for piece, at in ids.items()}
        self.special = {item["content"]: item["id"] for item in spec.get("added_tokens", [])}
        self.bytes_of.update({at: piece.encode() for piece, at in self.special.items()})
        self.width = max(self.bytes_of) + 1
        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        self.left = np.array([ids[left] for left, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[right] for _, right in pairs], dtype=np.int64)
        self.merged = np.array([ids[left + right] for left, right in pairs], dtype=np.int64)
        codes = self.left * self.width + self.right
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order
        self.special_cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; the number of merges where there is none."""
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], len(self.codes))


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def in_order(at: np.ndarray) -> np.ndarray:
    """Distinct positions, ascending."""
    at.sort()
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def merge_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each piece. One index holds, for every active pair, all its positions in all pieces.

    Pairs are taken in ascending rank from a heap. All positions of a pair that still hold it merge at once
    (of overlapping ones, as in a run of one letter, every other one from the left), and the pairs that
    arise beside them join the index under their own ranks.
    """
    sizes = np.array([len(piece) for piece in pieces], dtype=np.int64)
    token = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    total = len(token)
    token = np.append(token, -1)  # stands for the right neighbour of the last position of a piece
    if not total:
        return [[] for _ in pieces]
    ends = np.cumsum(sizes)
    after = np.arange(1, total + 1)
    after[ends[sizes > 0] - 1] = total  # the end of a piece has no right neighbour
    before = np.arange(-1, total - 1)
    before[(ends - sizes)[sizes > 0]] = -1
    nowhere = len(vocabulary.codes)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        ranks = vocabulary.rank(token[at], token[after[at]])
        known = ranks < nowhere
        at, ranks = at[known], ranks[known]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        if not len(at):
            return
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(at)], strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(active, rank)
            index[rank].append(at[start:end])

    enter(np.flatnonzero(after < total))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else in_order(np.concatenate(lists))
        at = at[(token[at] == vocabulary.left[rank]) & (token[after[at]] == vocabulary.right[rank])]
        if len(at) > 1:
            touching = after[at[:-1]] == at[1:]
            if touching.any():
                starts = np.flatnonzero(np.concatenate(([True], ~touching)))
                place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                at = at[place % 2 == 0]
        if not len(at):
            continue
        right = after[at]
        token[at] = vocabulary.merged[rank]
        token[right] = -1
        beyond = after[right]
        after[at] = beyond
        inside = beyond < total
        before[beyond[inside]] = at[inside]
        lefts = before[at]
        enter(in_order(np.concatenate([at[inside], lefts[lefts >= 0]])))
    alive = token[:total] >= 0
    kept = token[:total][alive].tolist()
    bounds = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))].tolist()
    return [kept[bounds[k]:bounds[k + 1]] for k in range(len(pieces))]


def blocks(text: str) -> Iterator[str]:
    """Cut a long text where no token can span: before white space that follows something else."""
    start = 0
    edge = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
    while len(text) - start > _BLOCK:
        cut = edge.search(text, start + _BLOCK)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def pieces_of(text: str, vocabulary: Vocabulary) -> Iterator[list[str]]:
    """Pieces of a text, block by block; a special token is a piece of its own."""
    parts = vocabulary.special_cut.split(text) if vocabulary.special_cut else [text]
    for part in parts:
        if part in vocabulary.special:
            yield [part]
        elif part:
            for block in blocks(part):
                yield PATTERN.findall(block)


class Coder:
    """Remembers pieces already merged by this task and ends with it; new ones of a group of texts are merged together.

    Pieces are held in two generations, and those in use move to the younger one: when it is full, the elder one is forgotten.
    With ``spells``, the decimal ids and decoded bytes of a piece are held in place of its ids.
    """

    def __init__(self, vocabulary: Vocabulary, spells: bool = False) -> None:
        self.vocabulary = vocabulary
        self.spells = spells
        self.held = 0
        self.ids: dict[str, array] = {}
        self.spelled: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.elder: tuple[dict, dict, dict] = ({}, {}, {})

    def known(self) -> dict:
        return self.spelled if self.spells else self.ids

    def learn(self, pieces: Iterable[str]) -> None:
        """All pieces are known after this."""
        known = self.known()
        missing = [piece for piece in pieces if piece not in known]
        mine = (self.ids, self.spelled, self.decoded)
        for before, now in zip(self.elder, mine, strict=True):
            now.update((piece, before.pop(piece)) for piece in missing if piece in before)
        new: list[str] = []
        size = 0
        for piece in missing:
            self.held += 8 * len(piece) + 300
            if piece in known:
                continue
            if piece in self.vocabulary.special:
                self.keep(piece, [self.vocabulary.special[piece]])
                continue
            new.append(piece)
            size += len(piece)
            if size >= _BLOCK:
                self.merge(new)
                new, size = [], 0
        self.merge(new)

    def merge(self, pieces: list[str]) -> None:
        for piece, ids in zip(pieces, merge_pieces([piece.encode("utf-8", "surrogatepass") for piece in pieces], self.vocabulary), strict=True):
            self.keep(piece, ids)

    def keep(self, piece: str, ids: list[int]) -> None:
        if self.spells:
            self.spelled[piece] = ",".join(map(str, ids))
            self.decoded[piece] = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))
        else:
            self.ids[piece] = array("l", ids)

    def cut_all(self, texts: list[str]) -> Iterator[list[str]]:
        """The pieces of each text, all of them learnt; equal pieces share one string."""
        if self.held > _REMEMBERED // 2:
            self.elder, self.held = (self.ids, self.spelled, self.decoded), 0
            self.ids, self.spelled, self.decoded = {}, {}, {}
        same: dict[str, str] = {}
        cut = []
        for text in texts:
            pieces: list[str] = []
            for block in pieces_of(text, self.vocabulary):
                pieces.extend(map(same.setdefault, block, block))
            cut.append(pieces)
        self.learn(same)
        yield from cut


def text_groups(texts: Iterable[str], characters: int = 16 * _BLOCK) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that the pieces held at once are bounded."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group


def vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of token ids) of every whole text; null counts as empty and has no ids.

    Special tokens in the text get their own id, and none is added. ``path`` names a file that every
    executor can open; by default the public tokenizers package is asked on the driver.
    """
    found = vocabulary_path(path)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(load(found))
        for batch in batches:
            out = [[at for piece in pieces for at in coder.ids[piece]] for group in text_groups(list(batch["text"])) for pieces in coder.cut_all(group)]
            yield pd.DataFrame({"id": batch["id"], "ids": out})

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(code, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded_text(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """Bytes that are not UTF-8 become replacement characters."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of each array of ids, special tokens included; null ids count as empty."""
    found = vocabulary_path(path)

    @F.pandas_udf("string")
    def turn(arrays: pd.Series) -> pd.Series:
        vocabulary = load(found)
        return pd.Series([decoded_text(ids if ids is not None else [], vocabulary) for ids in arrays])

    return encoded.withColumn(text, turn(ids_col))


def round_trips(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text; ids and texts stay inside the task.

    The ids and decoded bytes of a piece are looked up, so a text costs two joins over its pieces.
    """
    vocabulary = load(vocabulary_path(path))  # read on the driver: tasks get its arrays, not the file's parse

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary, spells=True)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            counts, ids_hashes, text_hashes = [], [], []
            for group in text_groups(value.as_py() for value in batch.column(1)):
                for pieces in coder.cut_all(group):
                    ids = ",".join(map(coder.spelled.__getitem__, pieces))
                    counts.append(ids.count(",") + bool(ids))
                    ids_hashes.append(sha(ids.encode()))
                    text_hashes.append(sha(b"".join(map(coder.decoded.__getitem__, pieces)).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hashes, pa.string()), pa.array(text_hashes, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_bpe": op4_bpe}
ORACLE: dict[str, str] = {}

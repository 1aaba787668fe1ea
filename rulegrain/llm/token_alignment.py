"""Cross-tokenizer alignment: how often tokens of two vocabularies share bytes, counted over a minimal perfect hash of the id pairs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rulegrain.llm.bpe import byte_letters
from rulegrain.llm.common import stored, table, text_of

BLOCK_BYTES = 4_000_000  # text of one block of documents; a longer document is a block of its own
SEGMENT = 32_768  # pairs of one piece of the hash and of one dense count vector
FAN_IN = 16  # vectors added by one node of the tree
_HELD = 4_000_000  # pairs whose counts a task holds before it passes them on
_WORDS = 24_000_000  # characters of the words whose ids a task remembers, each counted with 100 more
_SPACES = re.compile(r"\s{50000}")
# A piece: white space and what follows it. No token of A spans two, nor one of B while no longer piece of B holds the white space.
_PIECE = regex.compile(r"\p{White_Space}+\P{White_Space}*")
_PRIME, _FACTOR = 2_147_483_647, 1_103_515_245  # of the rule that deals pairs to segments


class Codec:
    """Vocabulary A (byte-level BPE) and B (pieces with byte fallback): ids of a text and bytes of an id."""

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {item["content"] for item in spec.get("added_tokens", [])}
        ids = spec["model"]["vocab"]
        ranks = {bytes(byte_of[letter] for letter in piece): at for piece, at in ids.items() if piece not in special}
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        merged = [ids[left + right] for left, right in merges]
        # ranks can stand for merges only where ids follow the order of the merges
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None
        self.path, self._library = path_a, None
        self.bytes_a: list[bytes] = [b""] * (max(ids.values()) + 1)
        for piece, at in ranks.items():
            self.bytes_a[at] = piece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b: list[bytes] = []
        for at in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(at)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(at) else piece.replace("▁", " ").encode())
        self.space = self.pieces.piece_to_id("▁")
        longer = {letter for at in range(self.pieces.get_piece_size()) if not self.pieces.is_byte(at) and len(self.pieces.id_to_piece(at)) > 1 for letter in self.pieces.id_to_piece(at)}
        self.joining = regex.compile("[▁" + "".join(x for x in sorted(longer) if regex.match(r"\p{White_Space}", x)) + "]")
        self.size_b = len(self.bytes_b)
        self.kind = np.dtype(np.uint16 if max(len(self.bytes_a), self.size_b) <= 65_536 else np.uint32)
        self.width_a = np.fromiter(map(len, self.bytes_a), dtype=np.int64)
        self.width_b = np.fromiter(map(len, self.bytes_b), dtype=np.int64)

    def ids_a(self, text: str) -> bytes:
        if self.fast is not None and (len(text) < 50_000 or _SPACES.search(text) is None):
            return np.array(self.fast.encode_ordinary(text), dtype=self.kind).tobytes()
        if self._library is None:  # the plain library for runs of white space that the fast one can't take
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def words_b(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of pieces of text that begin with white space. The model itself puts a space before each text."""
        asked = [word[1:] if word[0] == " " else word for word in words]
        for word, ids in zip(words, self.pieces.encode(asked, num_threads=1), strict=True):
            yield (ids or [self.space]) if word[0] == " " else ids[1:]


@lru_cache(maxsize=2)
def codec_of(paths: tuple[str, str, str]) -> Codec:
    return Codec(*paths)


def tokenizer_paths(path_a: str | None, path_b: str | None, pattern: str | None) -> tuple[str, str, str]:
    if path_a is None or path_b is None or pattern is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
        pattern = pattern or public_tokenizers.PATTERN
    return path_a, path_b, pattern


class Reader:
    """Encodes texts for one task and remembers the ids of words, as bytes, for as long as it lives."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.forget()

    def forget(self) -> None:
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.size = 0

    def learn(self, words: list[str]) -> None:
        """Encode new words together, and cut the ids where the words' bytes end."""
        codec = self.codec
        ended = [word for word in words if not word[-1].isspace()]  # after these a new piece of A begins in any case
        for word in words:
            if word[-1].isspace():
                self.known_a[word] = codec.ids_a(word)
        spelled = [word.encode("utf-8", "surrogatepass") for word in ended]
        ids = np.frombuffer(codec.ids_a("".join(ended)), dtype=codec.kind)
        stops = (np.searchsorted(np.cumsum(codec.width_a[ids]), np.cumsum([len(x) for x in spelled])) + 1) * codec.kind.itemsize
        data, start = ids.tobytes(), 0
        for word, stop in zip(ended, stops.tolist(), strict=True):
            self.known_a[word], start = data[start:stop], stop
        found = list(codec.words_b(words))
        flat = np.fromiter(chain.from_iterable(found), dtype=codec.kind).tobytes()
        start = 0
        for word, ids_b in zip(words, found, strict=True):
            stop = start + len(ids_b) * codec.kind.itemsize
            self.known_b[word], start = flat[start:stop], stop
        if self.spelled(flat, codec.bytes_b) != "".join(words).encode("utf-8", "surrogatepass"):
            self.odd.update(word for word in words if self.spelled(self.known_b[word], codec.bytes_b) != word.encode("utf-8", "surrogatepass"))
        self.size += sum(map(len, words)) + 100 * len(words)

    def spelled(self, ids: bytes, of: list[bytes]) -> bytes:
        return b"".join(map(of.__getitem__, np.frombuffer(ids, dtype=self.codec.kind).tolist()))

    def tokens(self, texts: list[str]) -> Iterator[tuple[bytes | None, bytes | None]]:
        """The ids of A and B of each text as bytes, or nulls where there are none or they do not spell space + text."""
        codec = self.codec
        cut = [_PIECE.findall(" " + text) if text and codec.joining.search(text) is None else [] for text in texts]
        if self.size > _WORDS:
            self.forget()
        new = list({word for words in cut for word in words if word not in self.known_b})
        for start in range(0, len(new), 20_000):
            self.learn(new[start:start + 20_000])
        for text, words in zip(texts, cut, strict=True):
            if not text:
                yield None, None
            elif words and (not self.odd or self.odd.isdisjoint(words)):
                yield b"".join(map(self.known_a.__getitem__, words)), b"".join(map(self.known_b.__getitem__, words))
            else:
                whole = " " + text
                a, b = codec.ids_a(whole), np.array(self.codec.pieces.encode(text), dtype=codec.kind).tobytes()
                same = self.spelled(a, codec.bytes_a) == self.spelled(b, codec.bytes_b) == whole.encode("utf-8", "surrogatepass")
                yield (a, b) if same else (None, None)


def packed(ids: bytes | None) -> bytes | None:
    return None if ids is None else zlib.compress(ids, 1)


def tokens(docs: DataFrame, paths: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``block``, ``id`` (as text), and the ids of A and B (16 or 32 bits each, deflated), null without tokens; a row per document."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(codec_of(paths))
        block, size = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            start = 0
            while start < len(batch):
                stop, held = start, 0
                while stop < len(batch) and held < BLOCK_BYTES // 4 and (size + held < BLOCK_BYTES or stop == start):
                    held += 4 + len(batch["text"].iat[stop])
                    stop += 1
                some = batch.iloc[start:stop]
                found = list(reader.tokens(list(some["text"])))
                yield pd.DataFrame({"block": block, "id": some["id"], "a": [packed(a) for a, _ in found], "b": [packed(b) for _, b in found]})
                start, size = stop, size + held
                if size >= BLOCK_BYTES:
                    block, size = block + 1, 0

    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(code, "block long, id string, a binary, b binary")


class Alignment:
    """Links and groups of several documents laid end to end; both token rows spell the same bytes."""

    def __init__(self, codec: Codec, a: Iterable[bytes | None], b: Iterable[bytes | None]) -> None:
        parts_a, parts_b = ([zlib.decompress(x) if x else b"" for x in column] for column in (a, b))
        width = codec.kind.itemsize
        self.bounds_a = np.concatenate(([0], np.cumsum([len(x) // width for x in parts_a], dtype=np.int64)))
        self.bounds_b = np.concatenate(([0], np.cumsum([len(x) // width for x in parts_b], dtype=np.int64)))
        self.a, self.b = np.frombuffer(b"".join(parts_a), dtype=codec.kind), np.frombuffer(b"".join(parts_b), dtype=codec.kind)
        self.ends_a, self.ends_b = np.cumsum(codec.width_a[self.a]), np.cumsum(codec.width_b[self.b])
        ends = np.concatenate([self.ends_a, self.ends_b])
        ends.sort(kind="stable")
        same = ends[1:] == ends[:-1]
        self.common = ends[1:][same]  # where a group ends
        cuts = ends[np.append(~same, True)] if len(ends) else ends
        # between two neighbouring cuts lies the overlap of exactly one token of A and one of B
        self.left, self.right = np.searchsorted(self.ends_a, cuts), np.searchsorted(self.ends_b, cuts)
        self.document = np.searchsorted(self.bounds_a, self.left, side="right") - 1
        self.pair = self.a[self.left].astype(np.int64) * codec.size_b + self.b[self.right]

    def once(self, codec: Codec) -> np.ndarray:
        """The pairs of each document, each once a document."""
        span = len(codec.bytes_a) * codec.size_b
        if not len(self.pair):
            return self.pair
        if len(self.bounds_a) * span < 1 << 62:
            return np.unique(self.document * span + self.pair) % span
        order = np.lexsort((self.pair, self.document))
        document, pair = self.document[order], self.pair[order]
        return pair[np.append(True, (document[1:] != document[:-1]) | (pair[1:] != pair[:-1]))]

    def groups(self, tables: dict[str, np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        in_a, in_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        until_a, until_b = np.searchsorted(self.ends_a, self.common, side="right"), np.searchsorted(self.ends_b, self.common, side="right")
        parts = np.empty(len(self.a) + len(self.b), dtype=object)
        last_a, last_b = self.common[in_a] == self.ends_a, self.common[in_b] == self.ends_b
        parts[np.arange(len(self.a)) + np.concatenate(([0], until_b))[in_a]] = np.where(last_a, tables["|"][self.a], tables[","][self.a])
        parts[np.arange(len(self.b)) + until_a[in_b]] = np.where(last_b, tables[";"][self.b], tables[","][self.b])
        bounds = (self.bounds_a + self.bounds_b).tolist()
        return [b"".join(parts[start:stop].tolist())[:-1] for start, stop in zip(bounds, bounds[1:], strict=False)]


def pair_counts(rows: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """``chunk``, ``pair``, ``docs``: documents of a part of the table that hold a pair linked; a pair occurs once a chunk."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, chunk = codec_of(paths), TaskContext.get().partitionId() << 33
        pairs, docs, waiting = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *waiting])
            times = np.concatenate([docs, np.ones(len(every) - len(pairs), dtype=np.int64)])
            found, at = np.unique(every, return_inverse=True)
            return found, np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)

        for batch in batches:
            for start in range(0, len(batch), 1000):
                some = batch.iloc[start:start + 1000]
                waiting.append(Alignment(codec, some["a"], some["b"]).once(codec))
                if sum(map(len, waiting)) > _HELD // 2:
                    pairs, docs = merged()
                    waiting = []
                    if len(pairs) > _HELD:
                        yield pd.DataFrame({"chunk": chunk, "pair": pairs, "docs": docs})
                        chunk, pairs, docs = chunk + 1, pairs[:0], docs[:0]
        pairs, docs = merged()
        yield pd.DataFrame({"chunk": chunk, "pair": pairs, "docs": docs})

    return rows.select("a", "b").filter("a IS NOT NULL").mapInPandas(count, "chunk long, pair long, docs long")


class PerfectHash:
    """A minimal perfect hash of distinct integers: a cascade of bit arrays, of which each takes the keys that stand alone in it."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = []
        total = 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys.astype(np.uint64) + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(8, 2 * len(rest) + 7 & ~7)
            places = cls.place(rest, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[places]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0 to n - 1 for the n keys it was built of; any of these or -1 for another, so callers compare keys."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            places = self.place(keys[todo], level, len(bits))
            hit = bits[places]
            out[todo[hit]] = self.ranks[level][places[hit]]
            todo = todo[~hit]
        return out

    def packed(self) -> bytes:
        return b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    def sizes(self) -> list[int]:
        return [len(bits) for bits in self.levels]

    @classmethod
    def unpacked(cls, data: bytes, sizes: Iterable[int]) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data[at:at + size // 8], dtype=np.uint8)).astype(bool))
            at += size // 8
        return cls(levels)


def segment_of(pair, segments: int):
    """The segment of a pair, by the same arithmetic for columns and arrays."""
    return pair % _PRIME * _FACTOR % _PRIME % segments


def hashes(pairs: DataFrame, segments: int) -> DataFrame:
    """``segment``, the packed hash (``bits``, ``sizes``) and its ``keys`` in hash order, from the distinct pairs."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(rows["pair"].to_numpy())
        found = PerfectHash.build(keys)
        placed = np.empty_like(keys)
        placed[found.index(keys)] = keys
        return pd.DataFrame({"segment": [rows["segment"].iat[0]], "bits": [found.packed()], "sizes": [found.sizes()], "keys": [placed.tobytes()]})

    rows = pairs.select(segment_of(F.col("pair"), segments).alias("segment"), "pair")
    return rows.groupBy("segment").applyInPandas(build, "segment long, bits binary, sizes array<int>, keys binary")


def looked_up(row, pairs: np.ndarray) -> np.ndarray:
    """Places of pairs in the segment of ``row``, each compared with the key that stands there."""
    at = PerfectHash.unpacked(row.bits, row.sizes).index(pairs)
    if not np.array_equal(np.frombuffer(row.keys, dtype=np.int64)[at], pairs) or (at < 0).any():
        raise ValueError("a pair is missing in its segment of the hash")
    return at


def summed(counts: DataFrame, found: DataFrame, segments: int, chunks: int) -> DataFrame:
    """The segments with ``vector``, the dense counts in hash order: leaves take some chunks each, and a tree adds them up."""
    lanes = max(1, -(-chunks // FAN_IN))

    def leaf(rows: pd.DataFrame, hashed: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(hashed):
            return pd.DataFrame({"segment": [], "lane": [], "vector": []})
        row = next(hashed.itertuples())
        vector = np.zeros(len(row.keys) // 8, dtype=np.int64)
        np.add.at(vector, looked_up(row, rows["pair"].to_numpy()), rows["docs"].to_numpy())
        return pd.DataFrame({"segment": [row.segment], "lane": [row.lane], "vector": [vector.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(vector, dtype=np.int64) for vector in rows["vector"]], axis=0)
        return pd.DataFrame({"segment": rows["segment"].iloc[:1], "lane": rows["lane"].iloc[:1], "vector": [total.astype(np.int64).tobytes()]})

    dealt = counts.select(
        segment_of(F.col("pair"), segments).alias("segment"), F.pmod(F.xxhash64("chunk"), F.lit(lanes)).alias("lane"), "pair", "docs")
    copies = found.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    schema = "segment long, lane long, vector binary"
    vectors = stored(dealt.groupBy("segment", "lane").cogroup(copies.groupBy("segment", "lane")).applyInPandas(leaf, schema))
    while lanes > 1:
        lanes = -(-lanes // FAN_IN)
        vectors = stored(vectors.withColumn("lane", F.col("lane") % lanes).groupBy("segment", "lane").applyInPandas(add, schema))
    return found.join(vectors.drop("lane"), "segment")


def highest(table_of: DataFrame, size_a: int, size_b: int) -> np.ndarray:
    """For each id of A the largest count of its pairs: one number an id of the vocabulary is collected, whatever the corpus."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, vector in zip(batch["keys"], batch["vector"], strict=True):
                top = np.zeros(size_a, dtype=np.int64)
                np.maximum.at(top, np.frombuffer(keys, dtype=np.int64) // size_b, np.frombuffer(vector, dtype=np.int64))
                yield pd.DataFrame({"a": np.flatnonzero(top), "count": top[top > 0]})

    rows = table_of.select("keys", "vector").mapInPandas(best, "a long, count long").groupBy("a").agg(F.max("count").alias("count"))
    out = np.zeros(size_a, dtype=np.int64)
    for row in rows.collect():
        out[row["a"]] = row["count"]
    return out


def pair_table(rows: DataFrame, paths: tuple[str, str, str]) -> tuple[DataFrame, int]:
    """The segments of the hash with keys and document counts of all pairs linked in ``rows`` (of :func:`tokens`), and their number."""
    counts = stored(pair_counts(rows, paths))
    pairs = stored(counts.select("pair").distinct())
    segments = max(1, -(-pairs.count() // SEGMENT))
    found = stored(hashes(pairs, segments))
    return stored(summed(counts, found, segments, counts.select("chunk").distinct().count())), segments


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, token, group and link counts, ``n_best``, ``count_sum`` and ``groups_sha256`` of every document.

    Texts are encoded once; the ids are stored in blocks of documents. The first pass over them aligns and counts pairs by
    document, the second aligns again and asks the hash for the pairs of each block, so no task or driver holds all pairs.
    Null and empty texts, and those that a vocabulary does not spell back (U+2581 in them, for one), have zeros and an empty digest.
    Repeated rows count as documents of their own; null ids stay; an empty table gives no rows; other columns play no part.
    """
    paths = tokenizer_paths(path_a, path_b, pattern)
    rows = stored(tokens(docs, paths, id_col, text_col))
    counted, segments = pair_table(rows, paths)
    codec = codec_of(paths)
    top = highest(counted, len(codec.bytes_a), codec.size_b)
    lanes = max(1, -(-rows.select("block").distinct().count() // 64))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(paths)
        for batch in batches:
            for block, some in batch.groupby("block", sort=False):
                pairs = np.unique(Alignment(codec, some["a"], some["b"]).pair)
                part = segment_of(pairs, segments)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(segments + 1))
                out = [(segment, pairs[order[start:stop]].tobytes()) for segment, (start, stop) in enumerate(zip(bounds, bounds[1:], strict=False)) if stop > start]
                yield pd.DataFrame({"segment": [s for s, _ in out], "lane": block % lanes, "block": block, "pairs": [p for _, p in out]})

    def answer(asked: pd.DataFrame, hashed: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"block": [], "pairs": [], "counts": []})
        row = next(hashed.itertuples())
        vector = np.frombuffer(row.vector, dtype=np.int64)
        found = [vector[looked_up(row, np.frombuffer(pairs, dtype=np.int64))].tobytes() for pairs in asked["pairs"]]
        return pd.DataFrame({"block": asked["block"], "pairs": asked["pairs"], "counts": found})

    def finish(some: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        codec = codec_of(paths)
        texts = {mark: np.array([f"{at}{mark}".encode() for at in range(max(len(codec.bytes_a), codec.size_b))], dtype=object) for mark in ",|;"}
        pairs = np.frombuffer(b"".join(answers["pairs"]), dtype=np.int64)
        counts = np.frombuffer(b"".join(answers["counts"]), dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        out = []
        for start in range(0, len(some), 500):
            part = some.iloc[start:start + 500]
            laid = Alignment(codec, part["a"], part["b"])
            at = np.searchsorted(pairs, laid.pair)
            if not np.array_equal(pairs[at], laid.pair):
                raise ValueError("a pair has no answer")
            count, size = counts[at], len(part)
            per = lambda which, weight=None: np.bincount(which, weights=weight, minlength=size).astype(np.int64)
            filled = np.flatnonzero(np.diff(laid.bounds_a) > 0)  # documents with tokens
            in_document = filled[np.searchsorted(laid.ends_a[laid.bounds_a[filled + 1] - 1], laid.common)]
            sums = np.zeros(size, dtype=np.int64)
            np.add.at(sums, laid.document, count)
            spelled = laid.groups(texts)
            out.append(pd.DataFrame({
                "id": part["id"], "n_a": np.diff(laid.bounds_a), "n_b": np.diff(laid.bounds_b), "n_groups": per(in_document), "n_links": per(laid.document),
                "n_best": per(laid.document, count == top[laid.a[laid.left]]), "count_sum": sums,
                "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in spelled]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n_a": []})

    asked = rows.select("block", "a", "b").filter("a IS NOT NULL").mapInPandas(ask, "segment long, lane long, block long, pairs binary")
    copies = counted.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    answers = asked.groupBy("segment", "lane").cogroup(copies.groupBy("segment", "lane")).applyInPandas(answer, "block long, pairs binary, counts binary")
    schema = "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    done = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, schema)
    return done.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE: dict[str, str] = {}

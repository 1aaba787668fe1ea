"""Cross-tokenizer alignment against plain Python over the public libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rulegrain.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, block long, a string, count long"


def plain(texts):
    """The columns of each text, by walking over the bytes."""
    public, tokenizers, sentencepiece = (pytest.importorskip(name) for name in ("public_tokenizers", "tokenizers", "sentencepiece"))
    one = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    letters = {letter: byte for byte, letter in enumerate(ta.byte_letters())}
    bytes_of_a = lambda at: bytes(letters[x] for x in one.id_to_token(at))
    bytes_of_b = lambda at: bytes([int(two.id_to_piece(at)[3:5], 16)]) if two.is_byte(at) else two.id_to_piece(at).replace("▁", " ").encode()
    found, count = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        parts_a, parts_b = [bytes_of_a(x) for x in a], [bytes_of_b(x) for x in b]
        if not text or not (b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode()):
            found.append(None)
            continue
        owner_a = [at for at, part in enumerate(parts_a) for _ in part]
        owner_b = [at for at, part in enumerate(parts_b) for _ in part]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends = set(np.cumsum([len(x) for x in parts_a]).tolist()) & set(np.cumsum([len(x) for x in parts_b]).tolist())
        groups, at_a, at_b, group_a, group_b = [], 0, 0, [], []
        for at in range(len(owner_a)):
            if at + 1 == len(owner_a) or owner_a[at + 1] != owner_a[at]:
                group_a.append(str(a[owner_a[at]]))
            if at + 1 == len(owner_b) or owner_b[at + 1] != owner_b[at]:
                group_b.append(str(b[owner_b[at]]))
            if at + 1 in ends:
                groups.append(",".join(group_a) + "|" + ",".join(group_b))
                group_a, group_b = [], []
        pairs = [(a[x], b[y]) for x, y in links]
        count.update(set(pairs))
        found.append((len(a), len(b), groups, pairs))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for item in found:
        if item is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, pairs = item
            out.append((n_a, n_b, len(groups), len(pairs), sum(count[p] == top[p[0]] for p in pairs), sum(count[p] for p in pairs),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def rows_of(df):
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [(row["id"], tuple(row[name] for name in columns)) for row in df.collect()]


def test_equals_brute_force(spark, monkeypatch):
    random = np.random.default_rng(9)
    letters = list("  \n\t\r\x0b\x00\xa0　aeinrst,.é漢😀09▁") + ["the ", " of", "ing", "<s>", "</s>", "<|endoftext|>", "<0x41>", "  "]
    texts = ["".join(random.choice(letters, random.integers(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "\n", "▁", "a", "same text twice", "same text twice", "x" * 60_000, " " * 60_000 + "y", "word and " * 20_000]
    rows = [(n, text, 1, "clash", None) for n, text in enumerate(texts)] + [(None, "no id", None, None, None), (5, texts[5], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = plain([row[1] for row in rows])
    expected = sorted(zip((row[0] for row in rows), wanted, strict=True), key=str)
    assert sorted(rows_of(ta.aligned(docs)), key=str) == expected
    assert ta.aligned(docs.filter("false")).isEmpty()
    assert ta.aligned(docs.filter("text IS NULL")).count() == 1


def test_small_pieces_of_everything(spark, monkeypatch):
    """Many blocks, segments, chunks and tree levels give the same as one of each."""
    texts = [f"Doc {n} tells of {n % 7} things, naïve or not.\n" * (1 + n % 5) for n in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    wanted = sorted(enumerate(plain(texts)))
    for name, value in (("BLOCK_BYTES", 400), ("SEGMENT", 20), ("FAN_IN", 2), ("_HELD", 30)):
        monkeypatch.setattr(ta, name, value)
    assert sorted(rows_of(ta.aligned(docs))) == wanted


def test_perfect_hash_is_minimal_and_perfect():
    random = np.random.default_rng(10)
    for size in (0, 1, 2, 100, 40_000):
        keys = np.unique(random.integers(0, 1 << 40, size))
        found = ta.PerfectHash.build(keys)
        again = ta.PerfectHash.unpacked(found.packed(), found.sizes())
        assert sorted(again.index(keys).tolist()) == list(range(len(keys)))

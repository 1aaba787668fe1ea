"""SimHash groups against plain Python."""

import re
from collections import defaultdict

import numpy as np
import xxhash

from rulegrain.llm import simhash

SCHEMA = "doc_id long, text string, print string, id long, label string"


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[at:at + size]) for at in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, reach=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= reach:
                one, two = sorted((root(a), root(b)))
                parent[two] = one
    return [root(at) for at in range(len(prints))]


def test_fingerprints_and_groups_equal_brute_force(spark):
    random = np.random.default_rng(7)
    words = [f"Word{n}" for n in range(300)] + ["naïve", "漢字", "😀"]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A  b\tC", "x" * 200_000, "ab " * 20_000, "no-break space"]
    for _ in range(25):
        first = list(random.choice(words, 200))
        for edits in (0, 1, 1, 2, 3):
            copy = list(first)
            for at in random.integers(0, 200, edits):
                copy[at] = str(random.choice(words))
            texts.append(" ".join(copy))
    rows = [(n, text, "clash", 5, "x") for n, text in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (None, "one two", None, None, None), (None, "alone among all", None, None, None)], SCHEMA)
    prints = [plain_fingerprint(text) for text in texts]
    wanted = plain_components(prints)
    found = simhash.near_groups(docs).collect()
    assert len(found) == len(texts) + 3
    for row in found:
        if row["id"] is not None:
            assert (row["print"] & (2**64 - 1), row["component_id"]) == (prints[row["id"]], wanted[row["id"]])
    assert sorted((row["component_id"] for row in found if row["id"] is None), key=str) == [5, None]
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {row["doc_id"] for row in kept.collect()} == set(wanted) | {None}
    assert simhash.near_groups(docs.filter("false")).isEmpty()


def test_large_buckets_are_refined_without_loss(spark):
    random = np.random.default_rng(8)
    centre = int(random.integers(1 << 62))
    values = {centre}
    for _ in range(400):  # a walk of small steps around one value, besides values far from all
        value = centre
        for bit in random.integers(0, 64, random.integers(1, 5)):
            value ^= 1 << int(bit)
        values.add(value)
    values |= {int(x) for x in random.integers(0, 1 << 63, 100)}
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    for reach in (1, 2):
        wanted = plain_components(values, reach)
        for bucket in (32, 512):
            rows = spark.createDataFrame([(v,) for v in signed], "print long")
            parent = defaultdict(lambda: None)

            def root(x):
                while parent[x] is not None:
                    x = parent[x]
                return x

            count = 0
            for row in simhash.links(rows, reach, bucket).collect():
                count += 1
                a, b = root(row["a"]), root(row["b"])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                assert ((row["a"] & (2**64 - 1)) ^ (row["b"] & (2**64 - 1))).bit_count() <= reach
            groups = defaultdict(set)
            for at, v in enumerate(signed):
                groups[root(v)].add(at)
            assert sorted(map(sorted, groups.values())) == sorted(sorted(at for at in range(len(values)) if wanted[at] == r) for r in set(wanted)), (reach, bucket)

"""The filter audit and its term matrix against plain Python."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np

from rulegrain.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, word string, shard long, good int, id string"


def plain(rows, labels):
    words_of = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = defaultdict(list)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    good, toxic = ({d for d, *marks in labels if marks[at] == 1 and d is not None} for at in (0, 1))
    docs = []
    for doc_id, text, source, *_ in rows:
        text, words = text or "", words_of(text)
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(other < doc_id for other in ids[text]) else set()
        docs.append((source or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {doc[0] for doc in docs}:
            left = [doc for doc in docs if doc[0] == part]
            seen = []
            for step, letter in enumerate(order, 1):
                gone = [doc for doc in left if letter in doc[1]]
                seen.append(letter)
                redundant = sum(doc[0] == part and letter in doc[1] and bool(doc[1] & set(seen[:-1])) for doc in docs)
                left = [doc for doc in left if letter not in doc[1]]
                unique = sum(doc[0] == part and doc[1] == {letter} for doc in docs)
                out[part, order, step] = (len(left), len(gone), redundant, unique, sum(doc[2] for doc in gone), sum(doc[3] for doc in gone))
                shapley[part, letter] += len(gone)
    return {key: (*values, shapley[key[0], key[1][key[2] - 1]]) for key, values in out.items()}


def test_equals_brute_force(spark, monkeypatch):
    random = np.random.default_rng(11)
    words = [f"w{n}" for n in range(90)] + ["CAPITALS", "#tag", "naïve", "漢", "a|b"]
    texts = [" ".join(random.choice(words[:random.integers(20, 95)], random.integers(0, 120))) for _ in range(90)]
    texts += [None, "", "", " ", "same text", "same text", "same text", "Ab\x0bcd\x1c\x85 nbsp joined", "long " * 30_000, "x" * 100_000]
    rows = [(n, text, ["s1", "", None, "zé"][n % 4], "clash", 3, 1, "c") for n, text in enumerate(texts)]
    rows += [rows[-5], rows[-5], (None, "same text", None, None, None, None, None), (None, None, "s1", None, None, None, None)]
    labels = [(n, n % 2, n % 3) for n in range(0, 100, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wanted = plain(rows, labels)
    for size, most in ((8_000_000, filter_audit._MOST), (500, filter_audit._MOST), (2000, 15)):  # at last with words that share a hash
        monkeypatch.setattr(filter_audit, "SHARD_BYTES", size)
        monkeypatch.setattr(filter_audit, "_MOST", most)
        found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, known).collect()}
        assert found == wanted
    assert filter_audit.audit(docs.filter("false"), known).isEmpty()
    assert filter_audit.audit(docs, known.filter("false")).count() == 3 * 600


def test_matrix_holds_every_count(spark):
    texts = ["a b a", "b c", "", "c c c A"]
    docs = spark.createDataFrame([(n, text, "s") for n, text in enumerate(texts)], "doc_id long, text string, source string")
    dictionary, shards = filter_audit.term_matrix(docs)
    term = {row["word"]: row["term"] for row in dictionary.collect()}
    assert set(term) == {"a", "b", "c", "A"} and len(set(term.values())) == 4
    name = {at: word for word, at in term.items()}
    for shard in shards.collect():
        columns, counts = np.frombuffer(shard["columns"], dtype=np.int64), np.frombuffer(shard["counts"], dtype=np.int32)
        for at, doc in enumerate(shard["ids"]):
            start, stop = shard["bounds"][at], shard["bounds"][at + 1]
            assert {name[c]: n for c, n in zip(columns[start:stop].tolist(), counts[start:stop].tolist(), strict=True)} == Counter(texts[doc].split())
            assert sorted(columns[start:stop].tolist()) == columns[start:stop].tolist()

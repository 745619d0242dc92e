"""Shared lines, ranked search and resampling towards a target, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.llm import lexical_search, line_dedup, target_sampling, words
from prismlake.llm.lexical_search import ImpactBlock, lexical_top_k
from prismlake.llm.line_dedup import dedup_lines
from prismlake.llm.minimal_hash import MinimalHash
from prismlake.llm.target_sampling import HeadVocabulary, bucket_gains, importance_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(UPPER))


def some_texts(n, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "river", "Ångström", "漢字", "x9", "a", "b", "night", "ferry", "É", "é", "0"]
    return [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) + rng.choice(["", ".", "\n!", "\x00\x7f"]) for _ in range(n)]


def test_words_in_pieces():
    for text in [*some_texts(40), None, "", "  ", "a" * 300, "x " * 500, "y" * 5 + " " + "z" * 200 + " w"]:
        for overlap in (0, 1, 2):
            whole = []
            for found, repeats in words.word_lists(text, overlap, piece_bytes=64):
                assert [w.decode() for w in found[:repeats]] == (whole[-repeats:] if repeats else []) and repeats <= overlap
                whole += [w.decode() for w in found[repeats:]]
            assert whole == plain_words(text)


def test_minimal_hash_numbers_every_key_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        keys[: n // 2] = keys[n - n // 2 :]  # keys alike in 64 bits differ in their marks
        marks = np.arange(n).astype(np.uint32)
        table = MinimalHash.from_bytes(MinimalHash.build(keys, marks).to_bytes())
        assert sorted(table.numbers(keys, marks).tolist()) == list(range(n))
        other = table.numbers(rng.integers(0, 2**63, 1000).astype(np.uint64), np.zeros(1000, np.uint32))
        assert ((other >= -1) & (other < max(n, 1))).all()


def plain_lines(rows, least_docs, least_chars):
    bare = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = {}
    for doc, text in rows:
        if doc is not None:
            for key in {bare(line) for line in (text or "").split("\n")}:
                if len(key) >= least_chars:
                    holders.setdefault(key, []).append(doc)
    keeper = {key: max(docs) for key, docs in holders.items() if len(docs) >= least_docs}
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc is None or keeper.get(bare(line), doc) == doc]
        found.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return found


def test_lines_that_documents_share(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 40)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    rng = np.random.default_rng(2)
    shared = [f"Line {k:03} of the Überfahrt" for k in range(60)] + ["short", "", "é" * 20, "é" * 19, "x" * 20 + "\x85"]
    rows = []
    for doc in range(150):
        lines = [" \t"[int(rng.integers(2))] + str(line) + ("\r" if rng.random() < 0.3 else "") for line in rng.choice(shared, int(rng.integers(1, 25)))]
        lines = [line.upper() if rng.random() < 0.2 and line.isascii() else line for line in lines] + [f"own line of document {doc:06}"] * 2 + ["held by all of them, every one"] * 2
        rows.append((doc, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, rows[0][1]), (None, None), (3, rows[3][1]), (503, "many \n" * 3000 + rows[9][1])]
    docs = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], "doc_id long, text string, lines string, n_lines int, doc int").repartition(5)
    got = [tuple(r) for r in dedup_lines(docs, 5, 20).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = plain_lines(rows, 5, 20)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 500 and max(r[2] for r in want) > 5
    assert dedup_lines(docs.limit(0)).count() == 0
    assert dedup_lines(docs, 10_000, 20).agg(F.sum("n_dropped")).first()[0] == 0


def plain_scores(documents, item):
    """(score, id) of all documents above 0, best first."""
    held = [(doc, Counter(plain_words(text))) for doc, text in documents]
    held = [(doc, tf) for doc, tf in held if tf]
    n_docs, n_terms = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(term for _, tf in held for term in tf)
    scored = []
    for doc, tf in held:
        m = 25 + 75 * sum(tf.values()) * n_docs // n_terms
        score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in plain_words(item) if tf[t])
        if score > 0 and doc is not None:
            scored.append((-score, doc))
    return [(-s, d) for s, d in sorted(scored)]


def test_lexical_search_equals_all_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 17)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)
    texts = some_texts(120)
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(texts[:20])] + [(300, None), (301, ""), (None, texts[0]), (302, texts[1] * 200), (303, "only here")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, terms string, n int").repartition(3)
    asked = [(1, "The river, the ferry!"), (2, texts[3]), (2, texts[4]), (2, texts[4]), (3, None), (4, "unheard"), (5, "only only here"), (6, "a b 0 é É"), (None, "river")]
    items = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id int, text string, score int")
    got = {}
    for r in lexical_top_k(docs, items, 10).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    want = {}
    for item, text in dict.fromkeys(a for a in asked if a[0] is not None):
        for rank, (score, doc) in enumerate(plain_scores(rows, text)[:10], 1):
            want.setdefault(item, []).append((rank, doc, score))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and set(want) == {1, 2, 5, 6}
    assert lexical_top_k(docs.limit(0), items).count() == 0 and lexical_top_k(docs, items.limit(0)).count() == 0


def test_best_positions_stop_early_and_miss_nothing():
    rng = np.random.default_rng(8)
    n, terms = 3000, 6
    impact = np.sort(rng.pareto(1.2, (n, terms)) * 1000).astype(np.int64)[rng.permutation(n)]
    impact[:, 1:] = impact[:, 1:] * (rng.random((n, terms - 1)) < 0.4)
    of, term = np.nonzero(impact)
    values = impact[of, term]
    order = np.lexsort((of, -values, term))
    of, term, values = of[order], term[order], values[order]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    block = ImpactBlock(np.arange(n) * 7, lexical_search._packed(np.unique(term), np.r_[starts, len(term)], of, values, np.r_[0, np.cumsum(np.bincount(of, minlength=n))], np.argsort(of, kind="stable")))
    for weights in (np.ones(3, np.int64), np.array([5, 0, 2])):
        asked = np.array([0, 3, 5])
        total = impact[:, asked] @ weights
        want = sorted(((int(s), d * 7) for d, s in enumerate(total) if s > 0), key=lambda x: (-x[0], x[1]))
        got, met = block.best(asked, weights, 10)
        assert got == want[:10] and met < n / 2
        bar = want[4][0]
        assert block.best(asked, weights, 10, bar)[0][:5] == want[:5] and block.best(asked, weights, 10, bar)[1] <= met
        assert block.best(asked, weights, 10, want[0][0] + 1)[0] == []
    assert block.best(np.array([77]), np.ones(1, np.int64), 10) == ([], 0)


def plain_sample(documents, target, percent, buckets, most_words, least_words, seed):
    def runs(text):
        w = plain_words(text)
        return [" ".join(w[k : k + n]) for n in range(1, most_words + 1) for k in range(len(w) - n + 1)]

    slot = lambda feature: zlib.crc32(feature.encode()) % buckets
    have, want = Counter(slot(f) for _, t in documents for f in runs(t)), Counter(slot(f) for t in target for f in runs(t))
    all_have, all_want = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (all_have + buckets) / ((have[b] + 1) * (all_want + buckets))))
    found = []
    for doc, text in documents:
        weight = sum(gain(slot(f)) for f in runs(text))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        found.append((doc, len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text)) >= least_words))
    able = sorted((f for f in found if f[4]), key=lambda f: (-f[3], f[0] is None, f[0]))
    ranks = {f: r for r, f in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*f[:4], ranks.get(f)) for f in found]


@pytest.mark.parametrize("most_words, head", [(1, 30_000), (1, 2), (2, 5), (3, 4)])
def test_resampling_equals_a_plain_count(spark, monkeypatch, most_words, head):
    monkeypatch.setattr(words, "PIECE_BYTES", 100)
    texts = some_texts(150, seed=9)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[2] * 40), (None, texts[1]), (503, texts[5]), (504, texts[5])]
    target = [*some_texts(10, seed=3), None, "night ferry " * 30]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, rank string, score int").repartition(3)
    got = importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 20, 50, most_words, 10, 7, head, head)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_sample(rows, target, 20, 50, most_words, 10, 7), key=key)


def test_resampling_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert importance_resample(none, docs).count() == 0
    assert {r.doc_id: r.n_features for r in importance_resample(docs, none).collect()} == {1: 2, 2: 0}
    assert bucket_gains(np.array([3, 0]), np.array([0, 0])).tolist() == [math.floor(1000 * math.log(5 / 8)), math.floor(1000 * math.log(5 / 2))]
    head = HeadVocabulary([b"a"], np.zeros(0, np.int64), 10)
    assert head.features([b"a", b"b"], 2)[1].tolist() == [zlib.crc32(b"a b") % 10]

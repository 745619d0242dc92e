"""Nulls, ties, repeats, long texts and clashing names, operator by operator."""

import base64
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
import plain
import tiktoken

from prismlake.llm import langid, toxicity
from prismlake.llm.bpe import bpe_digests, decode_bpe, encode_bpe
from prismlake.llm.embedding_dedup import embedding_duplicates
from prismlake.llm.graph import components
from prismlake.llm.minhash import near_duplicates
from prismlake.llm.mixing import mix
from prismlake.llm.pieces import TABLE_CHARS, PieceEncoder, safe_pieces
from prismlake.llm.token_counts import count_tokens
from prismlake.llm.token_shards import read_token_shards, write_token_shards
from prismlake.llm.vector_search import top_k
from prismlake.llm.warc import archive_round_trip, read_records

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    rng = np.random.default_rng(11)
    letters = list("aàeé tT  \n\n\t\r\x1c\x85\xa0 'sS.,!?0½²漢字😀ß_<|>") + ["<|endoftext|>", "the", "ing", "  ", "\n \n"]
    return ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(n)]


def test_pieces_encode_as_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, encoder = Tokenizer.from_file(JSON), PieceEncoder(JSON)
    texts = [*odd_texts(600), None, "a b" * 5000, *odd_texts(5)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for _ in range(2):
        data, ends = encoder.encode(pa.array(texts))
        assert [data[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        assert encoder.counts(pa.array(texts)).tolist() == list(map(len, want))
        encoder._held = TABLE_CHARS + 1  # the table starts anew
    assert all("".join(safe_pieces(x or "")) == (x or "") and all(safe_pieces(x or "")) for x in texts)


def test_bpe_in_many_rows_and_dictionaries(spark, library):
    rng = np.random.default_rng(6)
    texts = [*odd_texts(300), "x" * 5000, "".join(map(chr, rng.integers(97, 123, 3000))), None, "aaa" * 700]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, token_ids string, ids int").coalesce(1)
    encoded = encode_bpe(docs, RANKS, P.PATTERN, flush_chars=500, dictionary_chars=2000)
    got = Counter((r.doc_id, tuple(r.token_ids)) for r in encoded.collect())
    assert got == Counter((i if i % 50 else None, tuple(library.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    back = Counter((r.doc_id, bytes(r.decoded).decode()) for r in decode_bpe(encoded, RANKS).collect())
    assert back == Counter((i if i % 50 else None, t or "") for i, t in enumerate(texts))
    with pytest.raises(Exception, match="vocabulary"):
        decode_bpe(spark.createDataFrame([(1, [60_000])], "doc_id long, token_ids array<int>"), RANKS).collect()
    assert {(r.doc_id, r.n_tokens) for r in bpe_digests(docs.limit(0), RANKS, P.PATTERN).collect()} == set()


def test_shards_of_null_and_repeated_ids(spark):
    texts = [(None, "b"), (None, "a"), (3, "one two"), (3, "one"), (3, "one"), (-5, None), (7, "w " * 3000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, start int")
    runs = [[(r.doc_id, r.start, bytes(r.ids)) for r in sorted(read_token_shards(write_token_shards(d, JSON, 2, shard_bytes=60)).collect(), key=lambda r: r.start)] for d in (docs, docs.repartition(3))]
    assert runs[0] == runs[1] and [i for i, _, _ in runs[0]] == [None, None, -5, 3, 3, 3, 7]
    assert Counter(i for i, *_ in runs[0]) == Counter(i for i, _ in texts)
    counts = Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs, JSON).collect())
    assert counts == Counter((i, len(ids) // 4 - 1) for i, _, ids in runs[0])


def test_toxicity_equals_a_plain_version(spark):
    rng = np.random.default_rng(1)
    words = np.array(["the", "tion", "ering", "anou", "heble", "ststion", "ofre", "inly"])
    rows = [(i, " ".join(rng.choice(words, 30)) + (" idiot moron" if i % 5 == 0 else "")) for i in range(120)]
    rows += [(200, ""), (201, None), (202, "idiot " * 20_000), (3, rows[3][1]), (None, "moron")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows[:120] if i % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = Counter((r.doc_id, r.text, round(r.score, 3)) for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect())
    train = [(t, int(i % 5 == 0)) for i, t in rows if i is not None and i < 120 and i % 3]
    want = Counter((i, t, round(s, 3)) for (i, t), s in zip(rows, plain.toxicity_scores(train, [t for _, t in rows])))
    assert {(i, t) for i, t, _ in got} == {(i, t) for i, t, _ in want}
    near = {(i, t): s for i, t, s in want}
    assert all(abs(near[i, t] - s) < 0.02 for i, t, s in got) and sum(got.values()) == len(rows)


def test_toxicity_scans_texts_in_their_own_partitions(spark, monkeypatch):
    docs = spark.range(0, 120, 1, 12).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.when(F.col("id") % 3 == 0, "idiot moron").otherwise("kind words"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    plans, store = {}, toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().toString()) and store(df, label))
    toxicity.fit_toxicity(docs, labels)
    assert "Coalesce" not in plans["toxicity-sample"] and "REPARTITION_BY_NUM" in plans["toxicity-sample"]


def test_languages_equal_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "and", "tion"], "fr": ["le", "eaux", "est"], "de": ["der", "ung", "ß"], "": ["zz", "xx"], "es": ["los", "ción"]}
    rows = [(i, " ".join(rng.choice(parts[k], 6)), k) for i, k in enumerate(list(parts) * 12)]
    rows += [(900, None, "en"), (901, "² ½ ④", "en"), (902, "12 34", None), (903, "the " * 30_000, None), (904, "", None), (5, rows[5][1], rows[5][2]), (None, "le eaux", None), (905, "ª", None)]
    docs = spark.createDataFrame([(i, t, k, 0.5) for i, t, k in rows], "doc_id long, text string, lang string, Score double")
    want = Counter((i, lang, round(s, 6)) for (i, _, _), (lang, s) in zip(rows, plain.languages([(t, k) for _, t, k in rows], [t for _, t, _ in rows])))
    for block in (512, 2):  # one broadcast, and several
        monkeypatch.setattr(langid, "BLOCK_LANGUAGES", block)
        monkeypatch.setattr(langid, "HELD_LANGUAGES", block)
        got = langid.predict_languages(docs, langid.fit_languages(docs))
        assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got.collect()) == want


def test_mixing_equals_a_plain_version(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", None][i % 10 % 4]) for i in range(200)] + [(None, None, "a"), (5, "w " * 36, "b"), (5, "w " * 36, "b"), (300, "x " * 9000, "c"), (301, "", "none"), (302, None, "none")]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, target int")
    got = {}
    for r in mix(docs).collect():
        got.setdefault((r.doc_id, r.size, r.source), []).append(r.copies)
    want = {}
    for (i, t, s), times in plain.copies(spark, rows).items():
        want.setdefault((i, len((t or "").split()), s), []).extend(times)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    sizes = {s: sum(len((t or "").split()) for _, t, of in rows if of == s) for s in {r[2] for r in rows}}
    target = plain.targets(sizes)
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in mix(docs).collect())


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10**6, 40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, b), (2, c), (3, c), (4, a), (None, a), (None, a), (5, None), (6, "")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, id int, bucket string")).collect())
    assert got == Counter([(1, 1, True), (2, 2, True), (2, 2, True), (3, 2, False), (4, 1, False), (None, None, True), (None, None, True), (5, 5, True), (6, 6, True)])


def test_embeddings_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1, 24))
    x = np.r_[base + rng.normal(scale=0.33, size=(120, 24)), base * 1e200, base * 1e-200, rng.normal(size=(40, 24))]
    unit = x / np.abs(x).max(1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    mask = unit @ unit.T >= 0.9
    np.fill_diagonal(mask, False)
    root = np.arange(len(x))
    for _ in x:
        root = np.minimum(root, np.where(mask, root[None, :], 10**6).min(1))
    assert 100 < mask.sum() < len(x) ** 2 / 2
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "node": "clash", "key": 1}))
    got = {r.vec_id: r for r in embedding_duplicates(df, tile_rows=32).collect()}
    assert [got[i].n_links for i in range(len(x))] == mask.sum(1).tolist() and [got[i].component_id for i in range(len(x))] == root.tolist()
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.component_id) for r in embedding_duplicates(twice).collect()} == {(1, 1), (2, 1), (None, None)}


def test_queries_that_repeat(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], "clash") for k in range(1, 40)], "vec_id long, embedding array<double>, score string")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, asked, k=3).collect())
    best = lambda d: sorted(range(1, 40), key=lambda k: (-(k % (7, 5)[d]), k))[:3]
    assert got == Counter((0, n + 1, k, 65536 * (k % (7, 5)[d])) for d in (0, 1) for n, k in enumerate(best(d)))


def test_pages_that_repeat(spark):
    body = "é" * 700
    rows = [(4, "u", body), (4, "u", body), (2, "v", body), (None, "w", body), (5, None, "s" * 999)]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in archive_round_trip(spark.createDataFrame([(i, u, t, "x") for i, u, t in rows], "page_id long, url string, html string, payload_digest string")).collect())
    assert got[(2, "revisit", 4)] == 1 and got[(5, "response", None)] == 1 and sum(got.values()) == len(rows) and got[(4, "response", None)] >= 1


def test_fit_never_leads_away():
    """Newton steps of a separable, badly scaled problem still end in weights that tell the labels apart."""
    rng = np.random.default_rng(14)
    y = (np.arange(600) % 10 == 0).astype(float)
    rows = [np.unique(np.r_[rng.integers(0, 40, 6), np.arange(40, 160) if label else rng.integers(160, 4000, 300)]) for label in y]
    ends, places = np.cumsum([0, *map(len, rows)]), np.concatenate(rows)
    for seed in range(4):
        scale = np.random.default_rng(seed).normal(scale=6, size=4000)
        weight, bias = toxicity._logistic(ends, places, scale, y, toxicity.RIDGE)
        odds = np.array([(weight[r] * scale[r]).sum() + bias for r in rows])
        assert ((odds > 0) == (y == 1)).all()


def test_archives_cut_short_are_an_error():
    import gzip
    import io

    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    whole = head + b"abcde" + b"\r\n\r\n"
    assert [(r["size"], r["WARC-Type"]) for r in read_records(io.BytesIO(gzip.compress(whole) * 2))] == [(5, "response")] * 2
    for n in (3, 4, 7, len(whole) - 30):
        with pytest.raises(ValueError, match="ends inside"):
            list(read_records(io.BytesIO(gzip.compress(whole) + gzip.compress(whole[: len(whole) - n]))))


def test_toxicity_of_few_and_balanced_labels(spark):
    for texts in (["same words"] * 18, [chr(0x4E00 + 99 * k) * 9 for k in range(18)], [f"{'bad' if k % 2 else 'good'} words here" for k in range(18)]):
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as toxic"))).collect()}
        assert all(0 <= s <= 1 for s in scores.values())
        if "bad words here" in texts:
            assert all(scores[k] > 0.7 for k in range(1, 18, 2)) and all(scores[k] < 0.3 for k in range(0, 18, 2))
        else:
            assert all(abs(s - 0.5) < 1e-6 for s in scores.values())


def test_components_with_a_node_of_most_edges(spark):
    hub, chain, loop = [(9000, i) for i in range(3000)], [(20_000 + i, 20_001 + i) for i in range(60)], [(7, 7), (50_000, 50_000)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame([*hub, *chain, *loop, *hub[:50]], "u long, v long")).collect()}
    assert got == {(n, 0) for n in [*range(3000), 9000]} | {(n, 20_000) for n in range(20_000, 20_061)}


def test_new_pieces_are_encoded_few_at_a_time_and_once():
    import pyarrow as pa
    from tokenizers import Tokenizer

    encoder, whole = PieceEncoder(JSON), Tokenizer.from_file(JSON)
    texts = [" ".join(f"w{n}-{n % 7},x{n}" for n in range(at, at + 500)) for at in range(0, 3000, 500)] + ["a<|endoftext|>b c"]
    plain, calls = encoder._ids, []
    encoder._ids = lambda found: calls.append(found) or plain(found)
    data, places = encoder.encode(pa.array(texts))
    assert [data[a:b].tolist() for a, b in zip(places, places[1:])] == [whole.encode(text, add_special_tokens=False).ids for text in texts]
    assert max(len(text.split("<|endoftext|>")) for found in calls for text in found) <= 201
    calls.clear()
    encoder.encode(pa.array(texts))
    assert not calls

import base64
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from prismlake.llm.bpe import bpe_digests
from prismlake.llm.embedding_dedup import embedding_duplicates, linked_mask
from prismlake.llm.langid import fit_languages, predict_languages
from prismlake.llm.minhash import near_duplicates
from prismlake.llm.mixing import emit, mix
from prismlake.llm.pieces import safe_pieces
from prismlake.llm.sstable import ShardReader, ShardWriter, document_key
from prismlake.llm.token_counts import count_tokens
from prismlake.llm.token_shards import read_token_shards, write_token_shards
from prismlake.llm.toxicity import fit_toxicity, score_toxicity
from prismlake.llm.vector_search import top_k
from prismlake.llm.warc import archive_round_trip

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "a  b \n\n c\t d", "it's <|endoftext|> here's", "naïve Ωmega 漢字   x", "x" * 3000, "\n\nlead\n \nmid  ", "a\0b \0 c", "word " * 2000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def test_pieces_join_to_the_text():
    for t in ODD:
        assert "".join(safe_pieces(t or "")) == (t or "")


def test_counts_and_shards_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in ODD]
    docs = documents(spark, ODD).withColumn("n_tokens", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.doc_id: r for r in count_tokens(docs, JSON).collect()}
    assert [got[i].n_tokens for i in range(len(ODD))] == [len(w) for w in want]
    rows = sorted(read_token_shards(write_token_shards(docs, JSON, 2, shard_bytes=100)).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, w in zip(rows, want):
        assert np.frombuffer(r.ids, "<u4").tolist() == [*w, 2] and r.start == start
        start += r.n_tokens
    assert read_token_shards(write_token_shards(docs.limit(0), JSON, 2)).count() == 0


def test_shard_lookup():
    sink = io.BytesIO()
    w = ShardWriter(sink, 4)
    for i in [None, *range(-50, 30_000, 3)]:
        w.add(document_key(i), np.arange((i or 0) % 5, dtype="<u4").tobytes())
    w.close()
    r = ShardReader(sink)
    assert [len(x) for x in r.get(1)] == [1] and r.get(2) == [] and len(r.get(None)) == 1 and len(r.get(-50)) == 1
    assert sum(r.may_hold(i) for i in range(100_000, 110_000)) < 300


def test_bpe_equals_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "same row", "same row"]
    got = {r.doc_id: r for r in bpe_digests(documents(spark, texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_digests(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_mixing_nears_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", [None, "a", "b", "c"][0 if i % 50 == 0 else 1 + (i % 10 > 6) + (i % 10 > 8)], 0) for i in range(2000)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None), rows[5], rows[5]], DOCS)
    got = mix(docs).collect()
    again = mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 2003
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.1 * own[0].target + 60
        assert own[0].target <= 3 * own[0].source_size + 1e-6
    assert max(r.taken - 3 * r.size for r in got) <= 0
    assert abs(sum(t for t in {r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-3
    assert emit(docs, mix(docs)).count() == sum(r.copies for r in got)
    assert mix(docs.limit(0)).count() == 0


def test_toxicity_finds_held_out(spark):
    rng = np.random.default_rng(1)
    words = np.array(["the", "tion", "ering", "anou", "heble", "ststion", "ofre", "inly"])
    rows = [(i, " ".join(rng.choice(words, 40)) + (" idiot moron" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    right = sum((got[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 0)
    assert right >= 0.97 * 300 and 0 <= got[901] < 0.7
    assert score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).count() == 902


def test_language_of_held_out(spark):
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "and", "tion"], "fr": ["le", "eaux", "est"], "de": ["der", "ung", "ß"]}
    rows = [(i, " ".join(rng.choice(parts[k], 12)), k) for i, k in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict_languages(docs, fit_languages(docs.filter("doc_id % 4 <> 2"))).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert predict_languages(docs, fit_languages(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def plain_components(texts):
    """Shingle sets and smallest reachable index, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return sets, root


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts, base = [], [f"w{k}" for k in rng.integers(0, 5000, 120)]
    for i in range(60):
        t = list(base)
        for k in rng.integers(0, 120, i % 7):
            t[k] = f"x{rng.integers(0, 9999)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"w{k}" for k in rng.integers(0, 5000, 30)) for _ in range(40)] + ["", None, "A b", "a B", "one", texts[3], " ".join(base[:60])]
    sets, root = plain_components(texts)
    got = {r.doc_id: r for r in near_duplicates(documents(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_that_share_a_passage(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    passage, texts = word(100), []
    for i in range(150):
        own = passage + word(int(rng.integers(12, 45)))
        texts += [" ".join(own), " ".join(own[:-3] + word(3))][: 1 + (i % 3 == 0)]
    rng.shuffle(texts)
    sets, root = plain_components(texts)
    for size in (1 << 19, 900):
        monkeypatch.setattr("prismlake.llm.minhash.BLOCK_SHINGLES", size)
        got = {r.doc_id: r for r in near_duplicates(documents(spark, texts)).collect()}
        assert [got[i].component_id for i in range(len(texts))] == root
    assert 1 < len(set(root)) < len(texts)
    repeated = documents(spark, texts[:40]).union(documents(spark, ["", None, texts[0], " ".join(word(9))])).withColumn("n", F.lit("clash")).withColumn("root", F.lit(0))
    assert near_duplicates(repeated).count() == 44


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 8))
    rows = [*base, *(base[:20] + rng.normal(scale=0.15, size=(20, 8))), *([base[0]] * 5)]
    listed = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    return listed, spark.createDataFrame([*listed, (900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None]), (904, [])], "vec_id long, embedding array<float>")


def test_embeddings_equal_brute_force(spark):
    listed, df = vectors(spark)
    x = np.array([v for _, v in listed])
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert (linked_mask(x, x, 0.9) == (cos >= 0.9)).all()
    mask = cos >= 0.9
    np.fill_diagonal(mask, False)
    root = np.arange(len(x))
    for _ in x:
        root = np.minimum(root, np.where(mask, root[None, :], 10**6).min(1))
    got = {r.vec_id: r for r in embedding_duplicates(df, tile_rows=16).collect()}
    assert [got[i].n_links for i in range(len(x))] == mask.sum(1).tolist() and [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    listed, df = vectors(spark)
    q = np.floor(256 * np.array([v for _, v in listed]))
    got = {}
    for r in top_k(df, df.filter("vec_id % 10 = 0"), k=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    zero = [(901, np.zeros(8))]
    for i in range(0, len(q), 10):
        every = [(int(q[i] @ v), j) for j, v in [*enumerate(q), *zero] if j != i]
        assert got[i] == sorted(every, key=lambda p: (-p[0], p[1]))[:5]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_archives_round_trip(spark):
    big = "é<p>" * 300_000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "x" * 999), (4, "u\r\n", "x" * 999), (5, "http://c", None), (None, "http://d", big), (6, "http://e", "\r\n\r\n" * 400)]
    got = {r.page_id: r for r in archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, t in rows:
        body = (t or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha1(body).hexdigest()
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == got[3].record_type == got[None].record_type == "response"
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

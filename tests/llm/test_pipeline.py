import base64
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
import plain
import tiktoken

import corpus_pipeline as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _id string, tags map<string,string>"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(rows, labels, folder): toxic texts, near copies, nulls, empties, one id twice, clashing names."""
    rng = np.random.default_rng(8)
    words = {"en": ["the", "and", "tion", "ering", "house", "over"], "fr": ["le", "eaux", "est", "maison", "vous"]}
    rows, labels = [], []
    for i in range(150):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choice(words[lang], int(rng.integers(8, 60)))) + f" n{i} m{i * 7} k{i * 3} j{i}"
        toxic = int(i % 4 == 0)
        rows.append((i, text + (" idiot moron scum" if toxic else ""), lang, [None, "a", "b", "c"][i % 4], len(text), float(i), "zz", f"x{i}", {"k": "v"}))
        labels.append((i, int(rng.integers(0, 2)), toxic))
    long_text = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 5000))
    extra = [(200, rows[1][1]), (201, rows[1][1] + " tail"), (202, None), (203, ""), (204, "12 34 ²½"), (205, long_text), (206, long_text + " end"), (1, rows[1][1]), (None, "the lone row and over"), (None, None)]
    rows += [(i, t, None, "a", len(t or ""), 0.5, None, None, None) for i, t in extra]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, labels, folder


def clean(rows, labels):
    toxic = {i: y for i, _, y in labels}
    train = [(r[1], toxic[r[0]]) for r in rows if r[0] in toxic and r[1] is not None and plain.part(r[0], 3) != 1]
    return [r for r, s in zip(rows, plain.toxicity_scores(train, [r[1] for r in rows])) if s < C.TOXIC_AT]


def known(rows):
    answers = plain.languages([(r[1], r[2]) for r in rows if r[0] is not None and plain.part(r[0], 4) != 2], [r[1] for r in rows])
    return [r for r, (lang, score) in zip(rows, answers) if lang != "und" and score >= C.LEAST_LANGUAGE_SCORE]


def apart(rows):
    """One row of each group, by position; repeats of an id are one document."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rows = [rows[k] for k in order]
    _, root = plain.components([r[1] if r[0] is not None else None for r in rows])
    return [r for k, r in enumerate(rows) if r[0] is None or root[k] == k]


def keyed(rows):
    return Counter((r[0], r[1], r[3], r[5], r[7]) for r in rows)


def of(df):
    return keyed([(r.doc_id, r.text, r.lang, r.source, r.n_chars, r.score, r.lang_pred, r._id) for r in df.collect()])


def test_each_stage_against_a_plain_version(spark, corpus):
    rows, labels, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage, want in ((C.drop_toxic, clean(rows, labels)), (C.drop_unknown_language, known(rows))):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and of(out) == keyed(want) and 0 < len(want) < len(rows)
    once = apart([r for k, r in enumerate(rows) if r[0] != 1 or k == 1])
    got = C.drop_near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns and Counter(i for i, *_ in of(got).elements()) == Counter(r[0] for r in once)
    assert of(got) == of(C.drop_near_duplicates(spark, docs.repartition(5), folder))


def test_mixing_stage_against_a_plain_version(spark, corpus):
    rows, _, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = plain.copies(spark, [(r[0], r[1], r[3]) for r in rows])
    out = C.mix_sources(spark, docs, folder)
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    assert out.columns == docs.columns
    assert got == Counter({k: sum(c) for k, c in want.items() if sum(c)})
    assert C.mix_sources(spark, docs.limit(0), folder).count() == 0


def test_run_against_plain_versions(spark, corpus):
    rows, labels, folder = corpus
    kept = apart(known(clean([r for k, r in enumerate(rows) if r[0] != 1 or k == 1], labels)))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (i, text, _), times in plain.copies(spark, [(r[0], r[1], r[3]) for r in kept]).items():
        want[(i, *plain.digests(own, text))] += sum(times)
    single = spark.read.parquet(f"{folder}/documents.parquet")
    twice = f"{folder}-single"
    single.filter("not (doc_id <=> 1 and lang is null)").write.mode("overwrite").parquet(f"{twice}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.mode("overwrite").parquet(f"{twice}/labels.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, twice).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_language_stage_drops_what_no_language_explains(spark):
    """Three languages learned from the same words leave a text of them a third each; a text of one language's own words stays."""
    shared, own = "norde lav stien", ["qqqq qqq", "zzzz zzz", "wwww www"]
    rows = [(i, f"{shared} {own[i % 3]}", "abc"[i % 3]) for i in range(400)] + [(1000 + i, shared, "a") for i in range(4)] + [(2000 + i, "qqq qqqq", None) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").filter("doc_id < 1000 or doc_id >= 2000")
    asked = docs.unionByName(spark.createDataFrame([r[:2] for r in rows if 1000 <= r[0] < 2000], "doc_id long, text string").selectExpr("doc_id", "text", "null as lang"))
    kept = {r.doc_id for r in C.drop_unknown_language(spark, asked, "").collect()}
    assert kept >= set(range(400)) and kept >= set(range(2000, 2004)) and not kept & set(range(1000, 1004))


def test_stages_keep_a_table_of_equal_halves(spark, tmp_path):
    """As many toxic as clean rows and no common n-gram: every score is one half, and nothing goes."""
    rows = [(i, chr(0x4E00 + 40 * i) + "".join(chr(0x4E00 + 40 * i + k) for k in range(30))) for i in range(18)]
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert C.drop_toxic(spark, docs, str(tmp_path)).count() == 18


def test_stages_of_an_empty_table(spark, corpus):
    _, _, folder = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False))
    for _, stage in C.STAGES:
        assert stage(spark, none, folder).count() == 0

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .common import id_remainder, table
from .embedding_dedup import embedding_duplicates
from .langid import fit_languages, predict_languages
from .lexical_search import lexical_top_k
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix
from .target_sampling import importance_resample
from .token_counts import count_tokens
from .token_shards import read_token_shards, write_token_shards
from .toxicity import fit_toxicity, score_toxicity
from .vector_search import top_k
from .warc import archive_round_trip


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = write_token_shards(docs, tokenizer("byte_bpe_50k.json"), end_id=2)
    read = read_token_shards(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(True))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(True))
    model = fit_languages(docs.filter(~held_out))
    predicted = predict_languages(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op11_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` weighed towards ``benchmark`` by single words in 10,000 buckets; ten in a hundred are drawn."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resample(docs, target, percent=10, buckets=10_000, most_words=1, least_words=20, seed=2024)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for each item of ``benchmark``."""
    return lexical_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` without lines of 40 code points or more that 5 documents share."""
    left = dedup_lines(table(spark, sf_dir, "documents"), least_docs=5, least_chars=40)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op9_language_id": op9_language_id,
    "op4_bpe": op4_bpe,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_warc": op6_warc,
    "op7_top_k": op7_top_k,
    "op8_token_counts": op8_token_counts,
    "op10_minhash": op10_minhash,
    "op11_target_sampling": op11_target_sampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS chief FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> chief THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> chief THEN chief END AS refers_to
        FROM m
    """,
    "op7_top_k": """
        WITH usable AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op5_embedding_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN lowest ON lowest.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
    """,
    "op10_minhash": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM worded
        ), shingles AS (SELECT doc_id, len(s) AS n, unnest([hash(x) for x in s]) AS shingle FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common WHERE 100 * shared >= 75 * (na + nb - shared)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest ON a = doc_id
    """,
    "op11_target_sampling": r"""
        WITH folded AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), wanted AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
        ), polynomial AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
        ), had AS (SELECT doc_id, unnest(w) AS word FROM folded),
        words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM had UNION SELECT word FROM wanted)),
        hashed AS (
            SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
            FROM words, polynomial
        ), have AS (SELECT bucket, count(*) AS s FROM had JOIN hashed USING (word) GROUP BY bucket),
        want AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
        gains AS (
            SELECT word, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM had) + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM wanted) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM hashed LEFT JOIN have USING (bucket) LEFT JOIN want USING (bucket)
        ), weighed AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM had JOIN gains USING (word) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM folded LEFT JOIN weighed USING (doc_id)
        ), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
    """,
    "op12_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), long AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM long),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM whole) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs GROUP BY term),
        impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS impact
            FROM tfs JOIN long USING (doc_id) JOIN weights USING (term), whole
        ), scored AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN impacts USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
        shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, coalesce(k.doc_id <> s.keeper, false) AS goes FROM keyed k LEFT JOIN shared s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}

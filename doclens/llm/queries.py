"""The queries of this subpackage: thin forms of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.byte_bpe import encode_documents
from doclens.llm.common import Scratch, crc_fold
from doclens.llm.divergence import divergence
from doclens.llm.exact_dedup import exact_dedup
from doclens.llm.language import identify_language
from doclens.llm.mixing import mix
from doclens.llm.ngram_join import Join
from doclens.llm.packing import pack_documents
from doclens.llm.quality import score_quality
from doclens.llm.secret_scan import scan_secrets
from doclens.llm.token_alignment import align_tokens, pair_counts, score_links
from doclens.llm.topk_search import top_k
from doclens.llm.toxicity import score_toxicity
from doclens.llm.warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Join(table(spark, sf_dir, "documents"), n=3, num=90, den=100).components()
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def held_out(modulus: int, remainder: int):
    return F.coalesce(crc_fold(F.col("doc_id"), modulus) == remainder, F.lit(False)).alias("held_out")


def op4_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_fold(F.col("id"), 3) != 1)
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive(table(spark, sf_dir, "pages"))["records"]
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_language(table(spark, sf_dir, "documents"), crc_fold(F.col("id"), 4) != 2)
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def quality_folds() -> tuple:
    """Training rows, and the folds in which they are scored for calibration."""
    return crc_fold(F.col("id"), 5) != 0, crc_fold(F.col("id"), 5)


def op8_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), *quality_folds())
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op11_encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern(), decoded=True)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "alignment")
    aligned = align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    groups_sha = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit("")).alias("groups_sha256")
    aligned = scratch.table(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", groups_sha, "pairs", "times"), "aligned")
    return score_links(aligned, scratch.table(pair_counts(aligned), "counts"), scratch)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_pack_documents,
        op3_exact_dedup,
        op4_score_toxicity,
        op5_warc_bundles,
        op6_identify_language,
        op7_mix_sources,
        op8_score_quality,
        op9_topk_search,
        op10_scan_secrets,
        op11_encode_bytes,
        op12_align_tokens,
        op13_source_divergence,
    )
}

ORACLES = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])) END) AS gram
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id""",
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d""",
    "op5_warc_bundles": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(encode(coalesce(html, ''))) AS payload_digest, coalesce(html, '') AS html
  FROM pages),
g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM g""",
    "op9_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    # kinds in the contract's order, then the further ones; positions follow from the pieces between the matches
    "op10_scan_secrets": r"""
WITH r AS (SELECT * FROM (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
  (4, 'bearer', 'Bearer [A-Za-z0-9._~+/-]{20,}=*'), (5, 'jwt', 'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}')) t(k, kind, pattern)),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT n, k, kind, pattern, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS rest FROM d, r),
e AS (SELECT n, k, kind, pattern, unnest(hits) AS hit, unnest(rest[:len(hits)]) AS before, generate_subscripts(hits, 1) AS i FROM m),
s AS (SELECT n, k, kind, pattern, hit, sum(length(before) + length(hit)) OVER (PARTITION BY n, k ORDER BY i) AS stop FROM e),
h AS (SELECT n, k, kind, stop - length(hit) AS start, concat(kind, ':', stop - length(hit), ':', stop) AS span FROM s
  WHERE CASE k WHEN 0 THEN length(regexp_extract(hit, pattern, 2)) >= 6 WHEN 1 THEN length(hit) >= 20 WHEN 2 THEN length(hit) >= 24 ELSE true END)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN h USING (n) GROUP BY n, doc_id""",
    # every kept term of every group, counts of zero included
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (coalesce(s.n, 0) + 2 * v.v)::HUGEINT AS BIGINT) AS p,
         CAST(1 + 1000000000 * (k.n + 2)::HUGEINT // (v.n + 2 * v.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10""",
}

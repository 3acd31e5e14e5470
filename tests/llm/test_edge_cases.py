"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns, for every operator."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from doclens.llm import queries
from doclens.llm.common import crc_fold, shared_dir, words_of
from doclens.llm.exact_dedup import exact_dedup, keep_first
from doclens.llm.language import identify_language
from doclens.llm.mixing import mix, mixed_documents
from doclens.llm.ngram_join import Join, keep_representatives
from doclens.llm.packing import pack_documents
from doclens.llm.quality import keep_quality, score_quality
from doclens.llm.queries import tokenizer_path
from doclens.llm.secret_scan import scan_secrets
from doclens.llm.topk_search import top_k
from doclens.llm.toxicity import score_toxicity
from doclens.llm.warc import archive

LONG = "very long text with many words " * 40_000
ROWS = [
    (1, "one two three four five six", "en", "a"),
    (1, "one two three four five six", "en", "a"),
    (2, "one two three four five six", "en", None),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n", "en", "b"),
    (6, "word", None, "b"),
    (7, LONG, "en", "a"),
    (8, LONG + "end", "de", "c"),
    (9, "ünïcödé 💡 text\x0bwith\x0cblanks", "fr", "c"),
    (None, "no id here", "en", "c"),
    (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["with.dot", "with`tick", "id", "key", "size", "start", "c", "gram", "n", "sid", "bucket", "label", "y", "score", "block", "r", "mix_turn", "mix_id", "kept_id", "gone_id"]


def fold():
    return crc_fold(F.col("id"), 3) != 1


def documents(spark, rows=ROWS):
    d = spark.createDataFrame(rows, SCHEMA)
    return d.withColumns({c: F.lit(f"clash-{c}") for c in CLASHING})


def labels(spark, n=12):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, n)] + [(1, None, None), (None, 1, 1)] if n else []
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact_dedup": (lambda s, d: exact_dedup(d), len(ROWS)),
    "pack": (lambda s, d: pack_documents(d, tokenizer_path()).groupBy("doc_id").count(), None),
    "toxicity": (lambda s, d: score_toxicity(d, labels(s), fold()), len(ROWS)),
    "language": (lambda s, d: identify_language(d, fold()), len(ROWS)),
    "mix": (lambda s, d: mix(d), len(ROWS)),
    "quality": (lambda s, d: score_quality(d, labels(s), fold(), fold()), len(ROWS)),
    "secrets": (lambda s, d: scan_secrets(d), len(ROWS)),
    "join": (lambda s, d: Join(d, 3, 90, 100).components(), len(ROWS)),
    "pages": (lambda s, d: archive(d, "doc_id", "source", "text")["records"], len(ROWS)),
    "keep_first": (lambda s, d: keep_first(d), 7),
    "keep_representatives": (lambda s, d: keep_representatives(d), None),
    "keep_quality": (lambda s, d: keep_quality(d, labels(s), fold(), fold(), 0.0), len(ROWS)),
    "mixed_documents": (lambda s, d: mixed_documents(d), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, rows = OPERATORS[name]
    found = run(spark, documents(spark)).collect()
    assert rows is None or len(found) == rows
    assert found


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](spark, documents(spark, [])).collect() == []


def test_no_labels(spark):
    d = documents(spark)
    assert max(r["score"] for r in score_toxicity(d, labels(spark, 0), fold()).collect()) < 1e-9
    assert {r["score"] for r in score_quality(d, labels(spark, 0), fold(), fold()).collect()} == {0.5}


@pytest.mark.parametrize("name", ["keep_first", "keep_representatives", "keep_quality", "mixed_documents"])
def test_columns_come_back_as_they_were(spark, name):
    d = documents(spark)
    found = OPERATORS[name][0](spark, d)
    assert found.columns == d.columns
    assert all(r[c] == f"clash-{c}" for r in found.collect() for c in CLASHING)


def test_join_of_repeated_and_null_ids(spark):
    """An id has the links of all its rows; rows without an id have none, and no component."""
    rows = [(1, "a b c d e"), (1, "p q r s t u"), (1, "a b c d e"), (4, "a b c d e"), (7, "p q r s t u"), (9, "p q r s t u"), (0, "x y z"), (None, "a b c d e"), (None, None), (5, " "), (-(1 << 63), "x y z")]
    found = Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).components().collect()
    assert sorted(((r["id"], r["size"], r["component_id"]) for r in found), key=repr) == sorted([(1, 3, 1), (1, 3, 1), (1, 4, 1), (4, 3, 1), (7, 4, 1), (9, 4, 1), (0, 1, -(1 << 63)), (-(1 << 63), 1, -(1 << 63)), (None, 3, None), (None, 0, None), (5, 0, 5)], key=repr)


def test_dedup_of_repeated_null_and_smallest_ids(spark):
    least = -(1 << 63)
    rows = [(None, "ab"), (least, "a b"), (3, "ab"), (3, "ab"), (least, "q"), (None, None), (7, " ")]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found), key=repr) == sorted([(None, least, 4, False), (least, least, 4, True), (3, least, 4, False), (3, least, 4, False), (least, least, 1, True), (None, 7, 2, False), (7, 7, 2, True)], key=repr)


def test_values_of_odd_rows(spark):
    """What the docstrings promise for null, empty and repeated rows."""
    d = documents(spark)
    packed = pack_documents(d, tokenizer_path()).groupBy("doc_id", "piece").agg(F.count("*").alias("n"), F.min("length").alias("length")).collect()
    one = {(r["doc_id"], r["piece"]): (r["n"], r["length"]) for r in packed}
    assert one[3, 0] == one[4, 0] == one[5, 0] == (1, 1)
    assert one[1, 0][0] == 2 and one[None, 0][0] == 2
    assert max(k for i, k in one if i == 7) > 10
    mixed = {(r["doc_id"], r["source"]): r for r in mix(d).collect()}
    assert mixed[3, None]["size"] == mixed[4, "b"]["taken"] == 0
    assert all(r["taken"] <= 2 * r["size"] for r in mixed.values())
    secrets = {r["doc_id"]: (r["n_assign"], r["spans"]) for r in scan_secrets(d).collect()}
    assert secrets[3] == secrets[4] == (0, "")
    read = {r["id"]: (r["payload_bytes"], r["record_type"]) for r in archive(d, "doc_id", "source", "text")["records"].collect()}
    assert read[3] == (0, "response") and read[None][1] == "response"
    toxic = {r["doc_id"]: r["score"] for r in score_toxicity(d, labels(spark), fold()).collect()}
    assert toxic[3] == toxic[4] == toxic[5] and 0 < toxic[3] < 1


def test_one_word_of_many_megabytes(spark):
    """Longer than any chunk: hashed in steps, as a word of its own."""
    rows = [(1, "A" * 3_000_000), (2, "a" * 3_000_000), (3, "a" * 3_000_001), (4, "x " + "a" * 3_000_000), (5, "b " * 400_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: (r["size"], r["component_id"]) for r in Join(d, 3, 90, 100).components().collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 5)}
    assert score_quality(d, labels(spark), fold(), fold()).count() == 5


def test_words_that_a_polynomial_would_confuse():
    """Thue-Morse words and their complements: equal sums for every base modulo 2^64."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    pair = [bytes(97 + b for b in bits), bytes(98 - b for b in bits)]
    data = np.frombuffer(b" ".join(pair), np.uint8)
    hashes, _ = words_of(data, np.array([0, len(data)]))
    assert len(set(hashes.tolist())) == 2


def test_no_shared_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_numerals_are_no_letters(spark):
    rows = [(1, "½ ² Ⅷ ①"), (2, "12 !? _"), (3, "日本"), (4, "ª plain words of a text"), (5, "plain words of another text")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert [r["lang_pred"] for r in identify_language(d, F.lit(True)).orderBy("doc_id").collect()] == ["und", "und", "en", "en", "en"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_und_language(spark):
    found = {r["doc_id"]: r["lang_pred"] for r in identify_language(documents(spark), F.lit(True)).collect()}
    assert found[3] == found[4] == found[5] == "und"
    assert found[9] != "und"


def test_top_k_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [-0.001, 0.0], 1), (8, [1e200, 1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(d.where("vec_id <> 8"), F.col("vec_id") % 50 == 0, 2).collect()}
    assert found[(0, 1)] == found[(0, 2)] == (50, 256 * 256 + 512 * 512)
    assert found[(50, 2)] == (7, -256)
    assert top_k(d, F.col("vec_id") % 50 == 0, 2).count() == 4  # components beyond exact doubles
    assert top_k(d.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_of_empty_vectors(spark):
    rows = [(0, []), (50, [1.0]), (3, []), (4, [-1.0]), (5, [0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("with.dot", "query_id", "rank", "score", "part", "v")})
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(d, F.col("vec_id") % 50 == 0).collect())
    assert found == [(0, 1, 3, 0), (0, 2, 4, 0), (0, 3, 5, 0), (0, 4, 50, 0), (50, 1, 5, 256 * 128), (50, 2, 0, 0), (50, 3, 3, 0), (50, 4, 4, -65536)]


def test_top_k_of_vectors_of_several_lengths(spark, tmp_path):
    """As the SQL has it: one overlong vector takes nothing away from the others."""
    rng = random.Random(9)
    rows = [(n, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 20, 20, 20]))]) for n in range(300)] + [(300, [rng.uniform(-1, 1) for _ in range(33)])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    d.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = sorted(con.execute(queries.ORACLES["op9_topk_search"]).fetchall())
    assert len(expected) == 7 * 5
    columns = ("query_id", "rank", "vec_id", "score")
    for settings in ({}, {"cand_block": 16, "query_block": 2}, {"cand_block": 16, "query_block": 2, "pass_bytes": 400}):
        found = top_k(d, F.col("vec_id") % 50 == 0, **settings)
        assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == expected

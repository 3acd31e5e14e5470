"""Byte-level BPE against its library, alignment against byte ranges one by one, divergence against SQL."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doclens.llm import byte_bpe, divergence, queries, token_alignment
from doclens.llm.byte_bpe import Codec, PairTable, decode_ids, encode_documents, read_ranks
from doclens.llm.common import Scratch
from doclens.llm.token_alignment import align_tokens, pair_counts, score_links
from tests.llm.test_edge_cases import LONG, ROWS, documents

RANKS, PATTERN = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.tokenizer_pattern()
PATH_A, PATH_B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return Codec(RANKS, PATTERN)


def ids_of(codec, text):
    return np.frombuffer(codec.encode_texts([text])[0], np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeéñ  \n\t'sltdr019.,!?日本語🙂՘\x1c\x85　½ⅷ\U00011de1౜١"), max_size=60))
@example("a\U00011de1b c՘d")
def test_ids_equal_the_library(codec, library, text):
    assert ids_of(codec, text) == library.encode_ordinary(text)
    assert codec.ranks.decode(np.frombuffer(codec.encode_texts([text])[0], np.int32)).tobytes() == text.encode()


def test_every_character_has_the_library_s_class(codec, library):
    for start in range(0, 0x110000, 4096):
        text = " ".join(chr(c) + "a" for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        assert ids_of(codec, text) == library.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abé"), min_size=1, max_size=300), st.integers(0, 3))
@example("a" * 300, 0)
def test_one_merge_a_round_and_many_are_the_same(codec, library, text, widen):
    raw = text.encode()
    one = codec.ranks.merge_rows([raw], len(raw) + widen)[0].tolist()
    assert one == codec.ranks.merge_long(codec.ranks.of_byte[np.frombuffer(raw, np.uint8)]).tolist()
    assert one == library.encode_ordinary(text) or raw in codec.ranks.ranks


def test_a_lower_rank_that_arises_stops_a_round():
    """Ranks by which merging all places of one rank at once would be wrong: xy (rank 256) makes yx y mergeable first."""
    ranks = {bytes([b]): b + 10 for b in range(256)}
    ranks |= {b"ab": 300, b"abc": 5, b"abab": 6, b"cab": 7}
    made = byte_bpe.Ranks(ranks)
    for text in (b"ababab", b"abcabc", b"abababcab", b"cabab", b"aabbcabcab"):
        expected = [bytes([c]) for c in text]
        while True:
            found = [(ranks[x + y], k) for k, (x, y) in enumerate(zip(expected, expected[1:], strict=False)) if x + y in ranks]
            if not found:
                break
            k = min(found)[1]
            expected[k : k + 2] = [expected[k] + expected[k + 1]]
        ids = [ranks[t] for t in expected]
        assert made.merge_long(made.of_byte[np.frombuffer(text, np.uint8)]).tolist() == ids
        assert made.merge_rows([text], len(text))[0].tolist() == ids


def test_pair_table_of_keys_that_meet():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 200, (5000, 2)), axis=0).astype(np.int32)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert table.lookup(pairs[:, 0], pairs[:, 1]).tolist() == list(range(len(pairs)))
    known = set(map(tuple, pairs.tolist()))
    absent = np.array([(a, b) for a in range(-1, 210) for b in range(-1, 210) if (a, b) not in known], np.int32)
    assert (table.lookup(absent[:, 0], absent[:, 1]) == byte_bpe.NONE).all()


def test_windows_and_forgotten_pieces(library, monkeypatch):
    text = "some words, and Émile's  more!\n\nlast " * 60
    monkeypatch.setattr(byte_bpe, "WINDOW", 100)
    monkeypatch.setattr(byte_bpe.windows, "__defaults__", (100,))
    codec = Codec(RANKS, PATTERN, kept=5)
    assert len(list(byte_bpe.windows(text))) > 10
    for part in (text, text[:777], "x" * 5000, "a b" * 50):
        assert ids_of(codec, part) == library.encode_ordinary(part)


def test_encode_and_decode_documents(spark, library):
    made = encode_documents(documents(spark), RANKS, PATTERN, decoded=True)
    found = made.collect()
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in found), key=repr) == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS), key=repr)
    ids = spark.createDataFrame([(1, library.encode_ordinary("añ b")), (1, []), (None, None)], "doc_id long, ids array<int>")
    assert [(r["doc_id"], r["decoded"]) for r in decode_ids(ids, RANKS).collect()] == [(1, "añ b".encode()), (1, b""), (None, None)]
    assert encode_documents(documents(spark, []), RANKS, PATTERN).collect() == []
    with pytest.raises(Exception, match="no token"):
        decode_ids(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANKS).collect()


def test_op11_digests(spark, library, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for i, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    found = queries.op11_encode_bytes(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


ALPHABET = token_alignment.byte_alphabet()


def brute_force(both, texts):
    """Everything by byte ranges, link by link."""
    a, b = both
    docs = []
    for text in texts:
        spans = []
        plain = (" " + (text or "")).encode()
        for ids, said in ((a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(ALPHABET[c] for c in a.id_to_token(i))), (b.encode(text or ""), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(said(i))))
                at = own[-1][2]
            spans.append(own if text and b"".join(map(said, ids)) == plain else None)
        docs.append(([], []) if None in spans else tuple(spans))
    links = [[(x[0], y[0]) for x in p for y in q if x[1] < y[2] and y[1] < x[2]] for p, q in docs]
    counts = Counter(pair for own in links for pair in own)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (p, q), own in zip(docs, links, strict=True):
        ends = sorted({x[2] for x in p} & {y[2] for y in q})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[0]) for x in side if start <= x[1] < end) for side in (p, q)))
            start = end
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if p else ""
        out.append((len(p), len(q), len(groups), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), sha))
    return out


TEXTS = [None, "", " ", "a", "hello world", "hello world", "  two  spaces\n\nand\ttabs", "naïve café déjà", "日本語 text 🙂", "<s> </s> <unk> <0x41> <|endoftext|>", "▁ marks ▁x", "nul \x00 here", "ﬁ ½ ⅷ", "x" * 500, "unbelievable tokenization internationalisation " * 20]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_byte_ranges(spark, both, tmp_path):
    rng = random.Random(4)
    words = "the of and tokenization überall straße niño l'été foo_bar 3.1415 http://x.y/z ▁ \t \n 🙂".split(" ")
    texts = [*TEXTS, *(" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(40))]
    d = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").withColumns({"n": F.lit("clash"), "pair": F.lit("clash"), "_row": F.lit("clash"), "b": F.lit(1)})
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_align_tokens(spark, str(tmp_path)).collect()}
    assert [found[n] for n in range(len(texts))] == brute_force(both, texts)
    # most counts joined instead of sent
    scratch = Scratch(spark, "test")
    aligned = scratch.table(align_tokens(d, PATH_A, PATH_B), "aligned")
    counts = scratch.table(pair_counts(aligned), "counts")
    for most in (0, 10):
        again = {r["doc_id"]: (r["n_best"], r["count_sum"]) for r in score_links(aligned, counts, scratch, most).collect()}
        assert again == {n: f[4:6] for n, f in found.items()}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abé ▁\n日🙂.\x00\u2028"), max_size=30))
def test_chunks_align_as_any_text(both, text):
    parts = token_alignment._pair(PATH_A, PATH_B).documents([text], kept=5)[0]
    expected = brute_force(both, [text])[0]
    assert tuple(sum(c[k] for c in parts) for k in range(4)) == expected[:4]
    said = ";".join(c.groups for c in parts)
    assert (hashlib.sha256(said.encode()).hexdigest() if parts else "") == expected[-1]


def test_windows_align_as_whole_texts(monkeypatch):
    pair = token_alignment._pair(PATH_A, PATH_B)
    text = "Some words, and Émile's  more!\n\nLast word of it " * 30
    whole = pair.documents([text])[0]
    monkeypatch.setattr(token_alignment, "WINDOW", 100)
    monkeypatch.setattr(byte_bpe.windows, "__defaults__", (100,))
    assert len(list(pair.chunks(text))) > 5
    assert pair.documents([text])[0] == whole
    assert pair.documents(["no ▁ mark " * 50]) == [[]]


def test_alignment_of_odd_rows(spark):
    made = align_tokens(documents(spark), PATH_A, PATH_B, ids=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in made) == sorted((i is None, i or 0) for i, *_ in ROWS)
    for r in made:
        assert r["n_a"] == len(r["a_ids"]) and r["n_b"] == len(r["b_ids"]) and r["n_groups"] == len(r["cuts_a"]) == len(r["cuts_b"])
        assert r["n_links"] == sum(r["times"]) and (r["groups"] is None) == (r["n_a"] == 0)
        assert r["cuts_a"][-1:] == ([r["n_a"]] if r["n_a"] else []) and r["cuts_b"][-1:] == ([r["n_b"]] if r["n_b"] else [])
    scratch = Scratch(spark, "test")
    empty = scratch.table(align_tokens(documents(spark, []), PATH_A, PATH_B), "aligned")
    assert score_links(empty, scratch.table(pair_counts(empty), "counts"), scratch).collect() == []


# ---------------------------------------------------------------- divergence


def in_sql(spark, tmp_path, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "p", "v", "with.dot", "all_docs")})
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    answer = con.execute(queries.ORACLES["op13_source_divergence"])
    columns = [c[0] for c in answer.description]
    found = queries.op13_source_divergence(spark, str(tmp_path))
    assert sorted(found.columns) == sorted(columns)
    return sorted(tuple(r[c] for c in columns) for r in found.collect()), sorted(answer.fetchall())


def test_divergence_equals_its_sql(spark, tmp_path):
    rng = random.Random(6)
    words = ["Alpha", "beta", "BETA", "gamma", "d", "été", "日本", "It's", "x1y2", "mixed_case", "zeta", "ÉTÉ"]
    rows = [(n, " ".join(rng.choice(words[: 4 + n % 9]) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "é", "日", None, ""])) for n in range(300)]
    rows += [(1, None, "en", "only nulls"), (2, " 12 ", "fr", "x"), (3, "few words", "fr", "y"), (None, "alpha", "en", "a"), (4, "alpha beta " * 20_000, "en", "long")]
    found, expected = in_sql(spark, tmp_path, rows)
    assert found == expected
    assert any(r[2] == "term" for r in found) and ("fr", "x", "pair", "y", 0, 1) in found


def test_divergence_of_an_empty_table(spark, tmp_path):
    assert in_sql(spark, tmp_path, []) == ([], [])


def test_partial_counts_add_up(spark):
    rows = [(n, f"one two three{n % 7} One", "en", "a") for n in range(50)] + [(99, "one " * 100_000, "en", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for flush in (1, 100_000):
        n = divergence.count_terms(d, flush=flush).groupBy("source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()
        own = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in n}
        assert own["a", "one"] == (100, 50) and own["b", "one"] == (100_000, 1) and own["a", "two"] == (50, 50)


def test_shares_beyond_64_bits(spark):
    big = 10**15
    row = spark.createDataFrame([(big, big + 5, 10)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 2) // (big + 25)


def test_long_text_is_whole(spark):
    n = sum(r["n"] for r in divergence.count_terms(spark.createDataFrame([(LONG,)], "text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})).collect())
    assert n == len(LONG.split())

"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

Every token index is repeated over the bytes of its token, once for tokenizer A and once for B. Where the owner pair of
a byte differs from that of the byte before, a link (two token occurrences that overlap) begins; where both owners
change at once, a cut lies, and the cuts part the tokens into groups that cover the same bytes.

Links are counted over the whole corpus by the pair of ids they join; a document's links are then weighed by these
counts: the counts of up to BROADCAST_PAIRS pairs, the most frequent ones, go to every task, those of the others are
joined by pair. Tokenised once; between the two passes a table keeps, per document, its distinct pairs and how many
links each has.

Both tokenizers must end a token before a space behind a visible character. So a text is a row of chunks, whose tokens,
groups and links are each aligned once, many chunks in one array, and kept for when they come again.

Defined results: texts that are null or empty, or whose bytes one of the tokenizers changes, have no tokens, groups or
links; repeated rows and rows without an id are documents of their own; columns that are not asked for are not read.
Long texts are worked through in windows, so that they need little more memory than their ids.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doclens.llm.byte_bpe import WINDOW, list_array, text_groups, windows
from doclens.llm.common import Scratch, bound_batches, lean, quoted

#: Pairs of ids whose counts go to every task: 17 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Chunks that are kept.
KEPT = 200_000
#: Where a chunk ends, whatever the version of Unicode: neither pattern nor pieces of either tokenizer go on over a space
#: behind a visible character.
CHUNKS, VISIBLE = re.compile("(?<=[!-~À-ž])(?= )"), re.compile("[!-~À-ž]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of byte-level tokens stands for."""
    # fixed values, the alphabet of the vocabulary file: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTable:
    """The bytes of each token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)

    def owners(self, ids: np.ndarray) -> np.ndarray:
        """The index of the token that owns each byte."""
        return np.repeat(np.arange(len(ids), dtype=np.int32), self.lengths[ids])

    def said(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Pair:
    """Tokenizer A (byte-level BPE, a JSON file) and B (a sentencepiece model that puts a space before the text)."""

    def __init__(self, path_a: str, path_b: str, ids: bool = False):
        self.ids = ids
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings are plain text
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = ByteTable([bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode() for name in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = ByteTable([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # text is cut into chunks only where no token of B goes on over a blank
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.text = GroupText(len(names), len(pieces))
        self.seen: dict[str, Chunk | None] = {}

    def chunks(self, text: str) -> Iterator[list[str]]:
        """A space and the text, cut into chunks that each start with a space; a list for each window."""
        said = " " + text
        if not self.cuts:
            yield [said]
            return
        for start, end in windows(said) if len(said) > WINDOW else [(0, len(said))]:
            yield CHUNKS.split(said[start:end])

    def align(self, chunks: list[str]) -> list[Chunk | None]:
        """Each chunk aligned; None for one whose bytes a side changes.

        Chunks that may stand before any other are one text, in which they keep their tokens.
        """
        out: list[Chunk | None] = [None] * len(chunks)
        together, apart = [], []
        for n, c in enumerate(chunks):
            (together if VISIBLE.match(c[-1]) and "▁" not in c else apart).append(n)
        if together:
            found = self.stream([chunks[n] for n in together])
            if found is None:
                apart += together
            else:
                for n, chunk in zip(together, found, strict=True):
                    out[n] = chunk
        for n in apart:  # behind another chunk: a lone space has no token of B at the start of a text
            found = self.stream([" a", chunks[n]])
            out[n] = found[1] if found else None
        return out

    def stream(self, chunks: list[str]) -> list[Chunk] | None:
        """Chunks one behind the other as one array of bytes."""
        text = "".join(chunks)
        ids_a, ids_b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if not self.bytes_a.said(ids_a) == text.encode() == self.bytes_b.said(ids_b):
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        own_a, own_b = self.bytes_a.owners(a), self.bytes_b.owners(b)
        new_a, new_b = own_a[1:] != own_a[:-1], own_b[1:] != own_b[:-1]
        begins = np.append(0, np.flatnonzero(new_a | new_b) + 1)
        lasts = np.append(np.flatnonzero(new_a & new_b), len(own_a) - 1)
        cuts_a, cuts_b = own_a[lasts] + 1, own_b[lasts] + 1
        # a chunk ends with a group: groups, tokens, links up to the end of each
        ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        group = np.searchsorted(lasts, ends - 1) + 1
        if (lasts[group - 1] != ends - 1).any():
            return None
        words = self.text.of(a, b, cuts_a, cuts_b)
        pairs = (a[own_a[begins]] * RADIX + b[own_b[begins]]).tobytes()
        at = [np.append(0, x).tolist() for x in (group, cuts_a[group - 1], cuts_b[group - 1], np.searchsorted(begins, ends))]
        a, b, cuts_a, cuts_b = (x.astype(np.int64).tobytes() if self.ids else b"" for x in (a, b, cuts_a, cuts_b))
        out = []
        for g, g1, x, x1, y, y1, k, k1 in zip(*(side for bounds in at for side in (bounds, bounds[1:]))):
            said = "".join(words[x + y : x1 + y1])[:-1]
            out.append(Chunk(x1 - x, y1 - y, g1 - g, k1 - k, said, pairs[8 * k : 8 * k1], a[8 * x : 8 * x1], b[8 * y : 8 * y1], cuts_a[8 * g : 8 * g1], cuts_b[8 * g : 8 * g1], x, y))
        return out

    def documents(self, texts: list[str | None], kept: int = KEPT) -> list[list[Chunk]]:
        """The chunks of each text; none where the bytes differ or there are none. Texts together of bounded size."""
        cut = [[part for window in self.chunks(t) for part in window] if t else [] for t in texts]
        if len(self.seen) > kept:
            self.seen.clear()
        new = list({c for parts in cut for c in parts}.difference(self.seen))
        self.seen.update(zip(new, self.align(new), strict=True))
        found = [list(map(self.seen.__getitem__, parts)) for parts in cut]
        return [parts if None not in parts else [] for parts in found]


class Chunk(NamedTuple):
    """Counts of a chunk, its groups as text, the pairs of its links, its ids, and tokens up to each cut, as int64 bytes;
    these counts of tokens start at from_a and from_b."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: bytes
    a: bytes
    b: bytes
    cuts_a: bytes
    cuts_b: bytes
    from_a: int
    from_b: int


class GroupText:
    """Groups as text: `a1,a2|b1;a3|b2,b3`, decimal ids in order."""

    def __init__(self, size_a: int, size_b: int):
        a, b = [str(k) for k in range(size_a)], [str(k) for k in range(size_b)]
        self.words = [x + mark for names, marks in ((a, ",|"), (b, ",;")) for mark in marks for x in names]
        self.size_a = size_a
        self.size_b = size_b

    def of(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> list[str]:
        """The text in words, one for each token; a table has each id with either mark behind it."""
        group_a = np.repeat(np.arange(len(cuts_a)), np.diff(cuts_a, prepend=0))
        group_b = np.repeat(np.arange(len(cuts_b)), np.diff(cuts_b, prepend=0))
        said = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cuts_a - 1] = last_b[cuts_b - 1] = True
        said[np.arange(len(a)) + np.append(0, cuts_b)[group_a]] = a + last_a * self.size_a
        said[np.arange(len(b)) + cuts_a[group_b]] = b + 2 * self.size_a + last_b * self.size_b
        return list(map(self.words.__getitem__, said.tolist()))


@functools.lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str, ids: bool = False) -> Pair:
    return Pair(path_a, path_b, ids)


#: The columns of no chunk.
NO_CHUNKS: list[tuple] = [()] * 12
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
IDS = ", a_ids array<int>, b_ids array<int>, cuts_a array<int>, cuts_b array<int>"
#: A pair of ids as one number: id of A times this, plus id of B.
RADIX = 1 << 20


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, groups (text, null without tokens), pairs (distinct pairs of linked
    ids as id of A * RADIX + id of B, in order) and times (links of each); with `ids` also a_ids, b_ids, cuts_a, cuts_b:
    the ids, and how many of either there are up to the end of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b, ids)
        for batch in batches:
            for start, end in text_groups(batch.column(1)):
                docs = [list(zip(*parts, strict=True)) or NO_CHUNKS for parts in pair.documents(batch.column(1).slice(start, end - start).to_pylist())]
                columns = {"doc_id": batch.column(0).slice(start, end - start)}
                columns |= {name: pa.array([sum(d[k]) for d in docs], pa.int64()) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                columns["groups"] = pa.array([";".join(d[4]) if d[4] else None for d in docs], pa.string())
                counted = [np.unique(np.frombuffer(b"".join(d[5]), np.int64), return_counts=True) for d in docs]
                sizes = [len(x) for x, _ in counted]
                columns |= {"pairs": list_array(np.concatenate([x for x, _ in counted]), sizes), "times": list_array(np.concatenate([x for _, x in counted]).astype(np.int32), sizes)}
                if ids:
                    for name, k in (("a_ids", 6), ("b_ids", 7), ("cuts_a", 8), ("cuts_b", 9)):
                        lists = [np.frombuffer(b"".join(d[k]), np.int64) for d in docs]
                        if k > 7:  # from the start of the document, not of the array that the chunk was aligned in
                            moves = [np.cumsum([0, *d[k - 8]])[:-1] - np.array(d[k + 2], np.int64) for d in docs]
                            lists = [x + np.repeat(m, np.array(d[2], np.int64)) for x, m, d in zip(lists, moves, docs, strict=True)]
                        columns[name] = list_array(np.concatenate(lists).astype(np.int32), [len(x) for x in lists])
                yield pa.record_batch(columns)

    bound_batches(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(lean(run), ALIGNED + (IDS if ids else ""))


def linked_pairs(aligned: DataFrame, *more: str) -> DataFrame:
    """A row per document and distinct pair: more, pair, times."""
    both = F.explode(F.arrays_zip("pairs", "times")).alias("x")
    return aligned.select(*more, both).select(*more, F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus join it; best: no pair of the same id of B has more."""
    counts = linked_pairs(aligned).groupBy("pair").agg(F.sum("times").alias("n"))
    most = counts.groupBy((F.col("pair") % RADIX).alias("b")).agg(F.max("n").alias("most"))
    # a row per id of B: the vocabulary bounds it
    return counts.join(F.broadcast(most), F.col("pair") % RADIX == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, scratch: Scratch, most: int = BROADCAST_PAIRS) -> DataFrame:
    """aligned with n_best (links whose pair is best) and count_sum (of n over links). Both are tables that stay."""
    rows = scratch.table(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    bits = F.floor(F.log2("n")).cast("int")
    # how many pairs have about which count: a row for each power of two
    by_bits = dict(counts.groupBy(bits.alias("bits")).count().collect())
    least, held = 64, 0
    for power in sorted(by_bits, reverse=True):
        held += by_bits[power]
        if held > most:
            break
        least = power
    frequent = counts.where(bits >= least)
    links = linked_pairs(rows, "_row").join(F.broadcast(frequent), "pair", "left")
    best = F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best")
    total = F.sum(F.col("n") * F.col("times")).alias("count_sum")
    sums = links.where("n IS NOT NULL").groupBy("_row").agg(best, total)
    if held > most:
        rest = links.where("n IS NULL").select("_row", "pair", "times").join(counts.where(bits < least), "pair")
        sums = sums.unionByName(rest.groupBy("_row").agg(best, total)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    kept = [c for c in rows.columns if c not in ("_row", "pairs", "times")]
    return rows.join(sums, "_row", "left").select(*kept, zero("n_best"), zero("count_sum"))

"""Byte-level BPE encoding and decoding by a file of ranks, in padded numpy matrices.

A text is cut by the pattern; each distinct piece that is no token itself becomes a row of byte tokens, padded to its
length bucket. In each round every row merges its leftmost pair of minimum rank: ranks come from a hash table of pairs
of ids, the column behind the merge is taken out of all rows at once, and rows without a pair left leave the matrix.
A row longer than ROW_BYTES would take as many rounds as it has bytes; it is a matrix of its own, and a round merges all
places of its minimum rank from the left, up to the first behind which a lower rank arises: the same merges in the same
order.

Characters take the class, letter or number, that the tiktoken library's own pattern engine gives them, as its Unicode
version is not that of Python's.

Defined results: null text is empty text; empty text has no ids and decodes to nothing; null ids (of decode_ids) decode
to null; rows are taken as they are, repeated ones, null doc_ids and all; columns other than the two that are asked for
are not read, whatever they are called. Texts are cut into windows where a piece must end, so that a long text needs no
more memory than its own bytes and ids; a single piece is never cut.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import bound_batches, lean, quoted, text_buffer

#: No rank: above every id.
NONE = np.int32(2**31 - 1)
#: Bytes up to which a piece is a row among others.
ROW_BYTES = 256
#: Cells of a matrix.
CELLS = 1 << 20
#: Characters of a window of text, and pieces whose ids are kept.
WINDOW, KEPT = 1 << 18, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """Ranks of pairs of ids: an open hash table, looked up for many pairs at once."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = self.keys_of(left, right)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.ranks = np.full(1 << self.bits, NONE)
        at = self.slots_of(keys)
        while len(keys):  # of keys that meet, one stays and the others go on to the next slot
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], rank[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, rank, at = keys[rest], rank[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def keys_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def slots_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where it has none, as with padding (-1)."""
        keys = self.keys_of(left, right)
        at = self.slots_of(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        going = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(going):
            at[going] = (at[going] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[going]]
            hit = found == keys[going]
            out[going[hit]] = self.ranks[at[going[hit]]]
            going = going[~hit & (found != self.EMPTY)]
        return out


class Ranks:
    """The merges of a rank file: byte pieces to ids, ids to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)

    # ------------------------------------------------------------ encoding

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, int32."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[n] = np.array([whole], np.int32)
            elif len(piece) > ROW_BYTES:
                out[n] = self.merge_long(self.of_byte[np.frombuffer(piece, np.uint8)])
            else:  # buckets 4, 6, 8, 12, 16, 24, ... wide
                half = 1 << (max(len(piece), 3) - 1).bit_length() - 1
                buckets.setdefault(half * 3 // 2 if len(piece) <= half * 3 // 2 else half * 2, []).append(n)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for n, ids in zip(part, self.merge_rows([pieces[n] for n in part], width), strict=True):
                    out[n] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Pieces of at most `width` bytes in one matrix; its last column is padding always."""
        lengths = np.array([len(p) for p in pieces])
        filled = np.arange(width + 1) < lengths[:, None]
        ids = np.full(filled.shape, -1, np.int32)
        ids[filled] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(1)
            own = np.arange(len(rows))
            least = ranks[own, at]
            over = least == NONE
            if over.any():
                done = np.flatnonzero(over)
                sizes = (ids[done] >= 0).sum(1)
                for k, n, size in zip(done.tolist(), rows[done].tolist(), sizes.tolist(), strict=True):
                    out[n] = ids[k, :size].copy()
                going = ~over
                rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
                own = np.arange(len(rows))
                if not len(rows):
                    break
            ids[own, at] = least
            stays = np.ones(ids.shape, bool)
            stays[own, at + 1] = False
            ids = ids[stays].reshape(len(rows), -1)
            ranks = ranks[stays[:, :-1]].reshape(len(rows), -1)
            ranks[own, at] = self.pairs.lookup(ids[own, at], ids[own, at + 1])
            before = np.flatnonzero(at)
            ranks[before, at[before] - 1] = self.pairs.lookup(ids[before, at[before] - 1], ids[before, at[before]])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One row of any length: a round merges all places of the minimum rank that would come next one by one."""
        ranks = self.pairs.lookup(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            places = np.flatnonzero(ranks == least)
            # of pairs that overlap, every second from the left
            new = np.append(True, np.diff(places) > 1)
            turn = np.arange(len(places)) - np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
            places = places[turn % 2 == 0]
            # the pairs that arise with what stands before (merged already) and behind (not merged yet)
            merged = np.full(len(places), least, np.int32)
            before = np.where(places > 0, ids[places - 1], -1)
            before[1:][places[1:] - places[:-1] == 2] = least
            behind = np.append(ids, np.int32(-1))[places + 2]
            lower = np.minimum(self.pairs.lookup(before, merged), self.pairs.lookup(merged, behind)) < least
            if lower.any():
                places = places[: int(lower.argmax()) + 1]
            ids[places] = least
            stays = np.ones(len(ids), bool)
            stays[places + 1] = False
            ids, at = ids[stays], places - np.arange(len(places))
            ranks = ranks[stays[1:]]
            for touched in (at[at > 0] - 1, at[at < len(ranks)]):
                ranks[touched] = self.pairs.lookup(ids[touched], ids[touched + 1])
        return ids

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


@functools.cache
def _classes() -> tuple[regex.Pattern, dict[int, str]]:
    """Characters to which tiktoken's pattern engine gives another class than Python's, and stand-ins of the right one."""
    single = {bytes([b]): b for b in range(256)}
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = {}
    for pattern in (r"\p{L}", r"\p{N}"):  # what does not match has no tokens
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        known[pattern] = set(engine.decode(engine.encode_ordinary(points)))
    swap: dict[int, str] = {}
    for pattern in known:
        swap |= {ord(c): "!" for c in set(regex.findall(pattern, points)) - known[pattern]}
    for pattern, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "0")):
        swap |= {ord(c): stand_in for c in known[pattern] - set(regex.findall(pattern, points))}
    ranges, last = [], None
    for c in sorted(swap):
        if last is not None and c == last + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
        last = c
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else r"(?!)"), swap


#: A place where a piece ends under every pattern that starts a word at its blank.
SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def windows(text: str, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Cut a text before the blank between two letters, behind `size` characters each; where none comes, not at all."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if not found:
            break
        yield at, found.start()
        at = found.start()
    yield at, len(text)


class Codec:
    """Texts to ids and back; ids of the pieces seen last are kept."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT):
        self.ranks, self.kept = _ranks(path), kept
        self.cut = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.seen: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            odd, swap = _classes()
            if odd.search(text):
                same = text.translate(swap)
                return [text[m.start() : m.end()] for m in self.spans(same)]
        return self.cut(text)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes. Texts together should be of bounded size."""
        cut = [[self.pieces(text[a:b]) for a, b in windows(text)] if len(text) > WINDOW else [self.pieces(text)] for text in texts]
        if len(self.seen) > self.kept:
            self.seen.clear()
        new = list({p for parts in cut for part in parts for p in part}.difference(self.seen))
        made = self.ranks.encode_pieces([p.encode() for p in new])
        self.seen.update(zip(new, (ids.tobytes() for ids in made), strict=True))
        return [b"".join(self.seen[p] for part in parts for p in part) for parts in cut]


@functools.lru_cache(maxsize=2)
def _ranks(path: str) -> Ranks:
    return Ranks(read_ranks(path))


def text_groups(texts: pa.Array, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes; a longer text is a run of its own."""
    _, offsets = text_buffer(texts)
    at, n = 0, len(texts)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end
        at = end


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row doc_id, ids array<int>, and with `decoded` the bytes that the ids decode to, by the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for batch in batches:
            for start, end in text_groups(batch.column(1)):
                made = codec.encode_texts([t or "" for t in batch.column(1).slice(start, end - start).to_pylist()])
                ids = np.frombuffer(b"".join(made), np.int32)
                sizes = np.array([len(m) // 4 for m in made])
                columns = {"doc_id": batch.column(0).slice(start, end - start), "ids": list_array(ids, sizes)}
                if decoded:
                    columns["decoded"] = binary_array(codec.ranks.decode(ids), bytes_of(codec.ranks, ids, sizes))
                yield pa.record_batch(columns)

    bound_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>" + (", decoded binary" if decoded else "")
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(lean(run), schema)


def bytes_of(ranks: Ranks, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of each row of `sizes` ids."""
    total = np.append(0, np.cumsum(ranks.lengths[ids]))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def decode_ids(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row doc_id and the bytes its ids decode to; an id that is null or no token is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(ranks_path)
        for batch in batches:
            out = []
            for row in batch.column(1):
                ids = row.values
                if ids is None:
                    out.append(None)
                    continue
                if ids.null_count or (len(ids) and not 0 <= ids.to_numpy().min() <= ids.to_numpy().max() < len(ranks.lengths)):
                    raise ValueError("ids hold one that is no token")
                out.append(ranks.decode(ids.to_numpy(zero_copy_only=False).astype(np.int64)).tobytes())
            yield pa.record_batch({"doc_id": batch.column(0), "decoded": pa.array(out, pa.binary())})

    bound_batches(rows.sparkSession)
    return rows.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(ids_col)).cast("array<int>").alias("ids")).mapInArrow(lean(run), "doc_id long, decoded binary")

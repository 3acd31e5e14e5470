"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. For a
batch of texts the postings of the trigrams that some query names are built in one pass over the bytes; queries
intersect and unite postings to candidates, which the regular expression verifies. A rule without mandatory trigrams
scans every text.

Defined results: null text counts as empty; a text without matches has zero counts and the digest of the empty
string; repeated rows are rows of their own; offsets are code points of the whole text, of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import LOWER, bound_batches, lean, quoted, row_chunks, text_buffer


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and a test that a match must also pass."""

    kind: str
    pattern: str
    ignore_case: bool = False
    keep: Callable[[re.Match], bool] = lambda m: True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The rules of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", False, lambda m: len(m[0]) >= 24),
)
#: Further rules: their spans come on top.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}=*"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# ---------------------------------------------------------------- regular expression -> Boolean trigram query

#: A query is None (matches everything), a trigram, or ("and" | "or", set of queries).
MOST_STRINGS = 64


def _join(kind: str, parts: list):
    """and: None drops out. or: one None makes all None."""
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = {p for p in parts if p is not None}
    if not parts:
        return None
    return parts.pop() if len(parts) == 1 else (kind, frozenset(parts))


def _trigrams(strings: set[bytes]):
    """Any of the strings occurs: or over strings, and over a string's trigrams."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str):
    """The query of a pattern, over lower-cased ASCII bytes. Strings that a part surely equals are carried while few."""

    def walk(items) -> tuple[set[bytes] | None, list]:
        """(all strings the part can be, or None if not known; queries that hold anyway)."""
        exact, holds = {b""}, []
        for op, arg in items:
            own, more = single(op, arg)
            holds += more
            if own is None or exact is None:
                if exact:
                    holds.append(_trigrams(exact))
                exact = own
                if own is None:
                    exact = {b""}
                    holds.append(None)
                continue
            joined = {a + b for a in exact for b in own}
            if len(joined) > MOST_STRINGS:
                holds.append(_trigrams(exact))
                joined = own
            exact = joined
        return exact, holds

    def single(op, arg) -> tuple[set[bytes] | None, list]:
        if op is sre.LITERAL:
            return {chr(arg).lower().encode()}, []
        if op is sre.SUBPATTERN:
            return closed(arg[3])
        if op is sre.BRANCH:
            parts = [closed(p) for p in arg[1]]
            if all(e is not None and not h for e, h in parts):
                return set().union(*(e for e, _ in parts)), []
            return None, [_join("or", [_join("and", [*h, _trigrams(e) if e else None]) for e, h in parts])]
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 4:
            return {chr(x).lower().encode() for _, x in arg}, []
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            exact, holds = closed(body)
            if (low, high) == (0, 1) and exact is not None and not holds:
                return exact | {b""}, []
            return None, ([*holds, _trigrams(exact) if exact else None] if low else [])
        if op is sre.AT:
            return {b""}, []
        return None, []

    def closed(items) -> tuple[set[bytes] | None, list]:
        """A part whose exact strings are known as a whole, or only what holds of it."""
        items = list(items)
        parts = [single(*x) for x in items]
        if all(e is not None and not h for e, h in parts):
            exact = {b""}
            for e, _ in parts:
                exact = {a + b for a in exact for b in e}
            if len(exact) <= MOST_STRINGS:
                return exact, []
        exact, holds = walk(items)
        return None, [*holds, _trigrams(exact) if exact else None]

    exact, holds = walk(_parser.parse(pattern))
    return _join("and", [*holds, _trigrams(exact) if exact else None])


def query_trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(query_trigrams(q) for q in query[1]))


def evaluate(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows (sorted) that may match."""
    if query is None:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.zeros(0, np.int64))
    parts = sorted((evaluate(q, postings, n) for q in query[1]), key=len)
    out = parts[0]
    for part in parts[1:]:
        out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
    return out


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def build_postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[bytes, np.ndarray]:
    """Rows of each wanted trigram. wanted: a flag per 24-bit code."""
    if len(data) < 3:
        return {}
    low = LOWER[data].astype(np.int32)
    codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    at = np.flatnonzero(wanted[codes])
    rows = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[rows + 1]
    pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | rows[inside])
    codes, rows = pairs >> 32, pairs & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(codes)) + 1
    return {int(c[0]).to_bytes(3, "big"): r for c, r in zip(np.split(codes, cuts), np.split(rows, cuts), strict=True) if len(c)}


class Scanner:
    """Rules compiled for batches of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, query in self.rules:
            for t in query_trigrams(query):
                self.wanted[_code(t)] = True

    def scan(self, texts, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (start, order of the rule, end) by row; texts(row) gives a row's text."""
        postings = build_postings(data, offsets, self.wanted)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (rule, compiled, query) in enumerate(self.rules):
            for row in evaluate(query, postings, len(offsets) - 1).tolist():
                spans = [(m.start(), k, m.end()) for m in compiled.finditer(texts(row)) if rule.keep(m)]
                if spans:
                    found.setdefault(row, []).extend(spans)
        return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """Per row: id, a count per base rule (n_<kind>), base_sha256, spans."""
    kinds = [r.kind for r in (*base, *extra)]
    schema = f"{quoted(id_col)} long, {', '.join(f'n_{r.kind} long' for r in base)}, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner((*base, *extra))
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for start, end in row_chunks(offsets):
                part, base_at = data[offsets[start] : offsets[end]], offsets[start]
                at = offsets[start : end + 1] - base_at
                raw = part.tobytes()
                texts = [raw[at[i] : at[i + 1]].decode() for i in range(end - start)]
                found = scanner.scan(texts.__getitem__, part, at)
                counts = [[0] * (end - start) for _ in base]
                shas, spans = [], []
                for row in range(end - start):
                    own = sorted(found.get(row, ()))
                    for _, k, _ in own:
                        if k < len(base):
                            counts[k][row] += 1
                    said = [(k, f"{kinds[k]}:{a}:{b}") for a, k, b in own]
                    shas.append(hashlib.sha256(",".join(x for k, x in said if k < len(base)).encode()).hexdigest())
                    spans.append(",".join(x for _, x in said))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                    names=[id_col, *(f"n_{r.kind}" for r in base), "base_sha256", "spans"],
                )

    bound_batches(docs.sparkSession)
    return docs.select(F.col(quoted(id_col)).cast("long").alias(id_col), F.col(quoted(text_col)).alias("text")).mapInArrow(lean(run), schema)

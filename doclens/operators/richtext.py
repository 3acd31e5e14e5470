"""Inline runs: Markdown and back, differences of text and style, and merging edits into runs that are live.

A run is a dict with text and the styles of STYLES; `link` is a URL or None, flags are booleans, colour a name. Runs
of kind other than `text` (mentions, equations) stay whole or become their text. Offsets are UTF-16 units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from doclens.operators.diff import diff_text, units

FLAGS = ("bold", "italic", "strikethrough", "underline", "code")
STYLES = (*FLAGS, "color", "link")
PLAIN = dict.fromkeys(FLAGS, False) | {"color": "default", "link": None}
#: Marks in the order in which they are opened; the innermost is last.
MARKS = (("strikethrough", "~~", "~~"), ("bold", "**", "**"), ("italic", "_", "_"), ("underline", "<u>", "</u>"), ("code", "`", "`"))
SPECIAL = re.compile(r"([\\`*_\[\]<>~])")
#: Where a mark, a link or an escape may start.
OPENS = re.compile(r"[\\\[~*_<`]")
LINK = re.compile(r"\[((?:\\.|[^\]\\])*)\]\(([^)]*)\)")
#: Characters of both versions whose changes are held at once.
HELD_CHARS = 1 << 18


def run(text: str, kind: str = "text", **styles) -> dict:
    return {"text": text, "kind": kind, **PLAIN, **styles}


def style_of(one: dict) -> tuple:
    return tuple(one[k] for k in STYLES)


def joined(runs: list[dict]) -> list[dict]:
    """Adjacent text runs of one style as one; empty ones left out."""
    out: list[dict] = []
    for one in runs:
        if out and one["kind"] == out[-1]["kind"] == "text" and style_of(one) == style_of(out[-1]):
            out[-1] = out[-1] | {"text": out[-1]["text"] + one["text"]}
        elif one["text"] or one["kind"] != "text":
            out.append(dict(one))
    return out


def to_markdown(runs: list[dict]) -> str:
    """Canonical Markdown of runs: marks hug their words, blanks at a run's ends stay outside."""
    out = []
    for one in joined(runs):
        text = one["text"]
        core = text.strip()
        if not core:
            out.append(text)
            continue
        lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
        body = core if one["code"] else SPECIAL.sub(r"\\\1", core)
        for flag, left, right in reversed(MARKS):
            if one[flag]:
                body = left + body + right
        if one["link"] is not None:
            body = f"[{body}]({one['link']})"
        out.append(lead + body + trail)
    return "".join(out)


def from_markdown(text: str) -> list[dict]:
    """Runs of inline Markdown; marks that do not close are text."""
    out: list[dict] = []

    def closing(mark: str, at: int, end: int) -> int:
        while (at := text.find(mark, at, end)) >= 0:
            before = at
            while text[before - 1] == "\\":
                before -= 1
            if (at - before) % 2 == 0:  # an even number of backslashes escape each other
                break
            at += 1
        return at

    def walk(at: int, end: int, styles: dict) -> None:
        plain: list[str] = []

        def flush() -> None:
            out.append(run("".join(plain), **styles))
            plain.clear()

        while at < end:
            opens = OPENS.search(text, at, end)
            stop = opens.start() if opens else end
            if stop > at:
                plain.append(text[at:stop])
                at = stop
                continue
            if text[at] == "\\" and at + 1 < end and SPECIAL.match(text[at + 1]):
                plain.append(text[at + 1])
                at += 2
                continue
            link = LINK.match(text, at, end) if text[at] == "[" else None
            if link:
                flush()
                walk(link.start(1), link.end(1), styles | {"link": link[2]})
                at = link.end()
                continue
            for flag, left, right in MARKS:
                stop = closing(right, at + len(left) + 1, end) if text.startswith(left, at) and not styles.get(flag) else -1
                if stop > 0:
                    flush()
                    if flag == "code":
                        out.append(run(text[at + 1 : stop], **styles, code=True))
                    else:
                        walk(at + len(left), stop, styles | {flag: True})
                    at = stop + len(right)
                    break
            else:
                plain.append(text[at])
                at += 1
        flush()

    walk(0, len(text), {})
    return joined(out)


def text_of(runs: list[dict]) -> str:
    return "".join(r["text"] for r in runs)


def cut(runs: list[dict], start: int, end: int) -> list[dict]:
    """The runs over characters [start, end); a mention that is cut in part becomes text."""
    out, at = [], 0
    for one in runs:
        part = one["text"][max(start - at, 0) : max(end - at, 0)]
        at += len(one["text"])
        if part:
            out.append(dict(one) if part == one["text"] else one | {"text": part, "kind": "text"})
    return out


def inline_diff(base: list[dict], nxt: list[dict]) -> tuple[list[tuple[str, str]], list[tuple[int, int, dict]]]:
    """Spans (kind, text), and style changes (start, length, changed styles) on text that is kept, by next's characters; a
    change ends with its span."""
    spans = diff_text(text_of(base), text_of(nxt))
    of = lambda runs: [(style_of(r), len(r["text"])) for r in reversed(runs) if r["text"]]
    old, new, changes, b = of(base), of(nxt), [], 0

    def take(side: list[tuple[tuple, int]], most: int) -> int:
        """Characters of the first run, `most` at the most, taken off the side."""
        style, left = side.pop()
        if left > most:
            side.append((style, left - most))
        return min(left, most)

    for kind, text in spans:
        left, known = len(text), len(changes)
        while left:
            if kind == "keep":
                change = {s: n for s, o, n in zip(STYLES, old[-1][0], new[-1][0], strict=True) if o != n}
                size = take(new, take(old, min(left, new[-1][1])))
                if change and len(changes) > known and changes[-1][0] + changes[-1][1] == b and changes[-1][2] == change:
                    changes[-1] = (changes[-1][0], changes[-1][1] + size, change)
                elif change:
                    changes.append((b, size, change))
            else:
                size = take(old if kind == "delete" else new, left)
            left -= size
            b += size if kind != "delete" else 0
    return spans, changes


def merge(live: list[dict], base: list[dict], nxt: list[dict]) -> list[dict]:
    """next's text over the live runs: what is kept keeps its runs, what is new wears the style before it.

    Where the live text is not base's, next is written whole.
    """
    if text_of(live) != text_of(base):
        return joined(nxt)
    spans, changes = inline_diff(base, nxt)
    pieces: list[dict] = []
    a = b = 0
    for kind, text in spans:
        if kind == "keep":
            pieces += cut(live, a, a + len(text))
        elif kind == "insert":
            before = pieces[-1] if pieces else (live[0] if live else run(""))
            for one in cut(nxt, b, b + len(text)):
                flags = {f: one[f] or before[f] for f in FLAGS}
                pieces.append(one | flags | {"color": before["color"] if one["color"] == "default" else one["color"]})
        a += len(text) if kind != "insert" else 0
        b += len(text) if kind != "delete" else 0
    for start, length, change in changes:
        total = len(text_of(pieces))
        pieces = [*cut(pieces, 0, start), *(r | change for r in cut(pieces, start, start + length)), *cut(pieces, start + length, total)]
    return joined(pieces)


CHANGES = ArrayType(StructType([StructField("at", IntegerType()), StructField("length", IntegerType()), StructField("style", MapType(StringType(), StringType()))]))
RUN = StructType([StructField("text", StringType()), *(StructField(f, BooleanType()) for f in FLAGS), StructField("color", StringType()), StructField("link", StringType())])


ARROW_CHANGES = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("style", pa.map_(pa.string(), pa.string()))]))


def changes_of(base: str, nxt: str) -> list[dict]:
    """Style changes of next against base, in UTF-16 units of the next text; they come in order, so each unit counts once."""
    new = from_markdown(nxt)
    text, out, last, at = text_of(new), [], 0, 0
    for start, length, change in inline_diff(from_markdown(base), new)[1]:
        at += units(text[last:start])
        size = units(text[start : start + length])
        out.append({"at": at, "length": size, "style": [(k, str(v)) for k, v in change.items()]})
        last, at = start + length, at + size
    return out


@F.arrow_udf(CHANGES)
def style_changes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Style changes between two versions of inline Markdown, in UTF-16 units of the next text; given away in pieces, so
    that a batch of many rows does not hold the changes of all of them."""
    for base, nxt in batches:
        out, held = [], 0
        for x, y in zip(base, nxt, strict=True):
            x, y = x.as_py(), y.as_py()
            out.append(None if x is None or y is None else changes_of(x, y))
            held += len(x or "") + len(y or "")
            if held >= HELD_CHARS:
                yield pa.array(out, ARROW_CHANGES)
                out, held = [], 0
        if out or not len(base):
            yield pa.array(out, ARROW_CHANGES)


@F.pandas_udf(ArrayType(RUN))
def markdown_runs(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{k: r[k] for k in ("text", *STYLES)} for r in from_markdown(t)] for t in text])

"""Markdown as blocks: a line-based parser of the dialect, its table function, and flattening with parents."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

FENCE = re.compile(r"^(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
TODO = re.compile(r"^\[([ xX])\]\s+(.*)$")
RULE = re.compile(r"^\s*([-*_])(\s*\1){2,}\s*$")
COMMENT = re.compile(r"^<!--\s*(.*?)\s*-->$")
INLINE = ((re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"(\*\*|__|~~|\*|_|`)(\S(?:.*?\S)?)\1"), r"\2"), (re.compile(r"\\([\\`*_{}\[\]()#+\-.!~>|])"), r"\1"))


def plain(markdown: str) -> str:
    """The text of inline Markdown, without its marks."""
    before = None
    while markdown != before:
        before = markdown
        for pattern, put in INLINE[:3]:
            markdown = pattern.sub(put, markdown)
    return INLINE[3][0].sub(INLINE[3][1], markdown)


def parse(text: str) -> Iterator[tuple[int, int | None, int, str, str, str]]:
    """(block, parent, depth, type, markdown, text) in document order.

    A list item, a table row and a quote are blocks; items nest by indentation, rows hang under their table.
    """
    lines, at, number = text.split("\n"), 0, 0
    open_items: list[tuple[int, int]] = []  # (indent, block)

    def out(type_: str, markdown: str, body: str, parent: int | None = None, depth: int = 0):
        nonlocal number
        number += 1
        return (number - 1, parent, depth, type_, markdown, body)

    if lines and lines[0] == "---" and "---" in lines[1:]:
        at = lines.index("---", 1) + 1
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
            continue
        item = ITEM.match(line)
        if not item or RULE.match(line):
            open_items = []
        if fence := FENCE.match(line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].startswith(fence[1])), len(lines))
            yield out("code", "\n".join(lines[at : end + 1]), "\n".join(lines[at + 1 : end]))
            at = end + 1
        elif head := HEADING.match(line):
            yield out(f"heading_{len(head[1])}", line, plain(head[2]))
            at += 1
        elif RULE.match(line):
            yield out("divider", line, "")
            at += 1
        elif note := COMMENT.match(line):
            yield out("pagebreak" if note[1].endswith("pagebreak") else "comment", line, note[1])
            at += 1
        elif item:
            indent = len(item[1].expandtabs(4))
            while open_items and open_items[-1][0] >= indent:
                open_items.pop()
            todo = TODO.match(item[3])
            type_ = "to_do" if todo else ("numbered_list_item" if item[2][0].isdigit() else "bulleted_list_item")
            row = out(type_, line.strip(), plain(todo[2] if todo else item[3]), open_items[-1][1] if open_items else None, len(open_items))
            open_items.append((indent, row[0]))
            yield row
            at += 1
        elif line.startswith(">"):
            end = next((k for k in range(at, len(lines)) if not lines[k].startswith(">")), len(lines))
            body = [re.sub(r"^> ?", "", x) for x in lines[at:end]]
            yield out("callout" if body[0].startswith("[!") else "quote", "\n".join(lines[at:end]), plain("\n".join(body)))
            at = end
        elif line.startswith("|"):
            end = next((k for k in range(at, len(lines)) if not lines[k].startswith("|")), len(lines))
            table = out("table", "\n".join(lines[at:end]), "")
            yield table
            for row in lines[at:end]:
                cells = [c.strip() for c in re.split(r"(?<!\\)\|", row.strip().strip("|"))]
                if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                    yield out("table_row", row, "\t".join(plain(c) for c in cells), table[0], 1)
            at = end
        else:
            end = next((k for k in range(at, len(lines)) if not lines[k].strip() or HEADING.match(lines[k]) or FENCE.match(lines[k]) or ITEM.match(lines[k]) or lines[k][0] in ">|"), len(lines))
            yield out("paragraph", "\n".join(lines[at:end]), plain("\n".join(lines[at:end])))
            at = end


@udtf(returnType="block int, parent int, depth int, type string, markdown string, text string", useArrow=False)
class MarkdownBlocks:
    """Rows of parse() for a text; none for null."""

    def eval(self, text: str):
        if text is not None:
            yield from parse(text)


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, block, parent, depth, type, markdown, text of each document: parsed where the rows are, no shuffle."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, block int, parent int, depth int, type string, markdown string, text string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(parse(text)) if text is not None else []
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(rows), batch.schema.field(0).type), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "block", "parent", "depth", "type", "markdown", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)

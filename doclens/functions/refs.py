"""Column functions on source references: literal refs, URLs, canonical ids, links to open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions.text import let

#: Shapes of ids.
HEX_ID = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
HEX_IN_PATH = r"(?i)(?<![0-9a-f])(?:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32})(?![0-9a-f])"
FILE_ID = r"^[A-Za-z0-9_-]{20,}$"
TAB_ID = r"^t\.[A-Za-z0-9_-]+$"
EVENT_ID = r"^[a-v0-9]{5,1024}$"
LITERAL = r"^([A-Za-z]+):([^\s/]+)$"
PRIMARY = "primary"


def canonical_hex(id_: Column) -> Column:
    return F.when(id_.rlike(HEX_ID), F.lower(F.replace(id_, F.lit("-"), F.lit(""))))


def series_of(event: Column) -> Column:
    """An instance id cut at its start time."""
    return F.regexp_replace(event, "_[A-Za-z0-9]*$", "")


def calendar_id(event: Column, calendar: Column) -> Column:
    return F.when(calendar == PRIMARY, event).otherwise(F.concat(event, F.lit("@"), calendar))


def parse_literal(text: Column) -> Column:
    """struct(source, id, problem); all null where the text is no literal ref."""
    trimmed = F.trim(text)
    source, id_ = F.regexp_extract(trimmed, LITERAL, 1), F.regexp_extract(trimmed, LITERAL, 2)
    hexed = canonical_hex(id_)
    doc, has_tab = F.substring_index(id_, "#", 1), F.contains(id_, F.lit("#"))
    tab = F.regexp_replace(id_, "(?s)^[^#]*#?", "")
    has_calendar = F.contains(id_, F.lit("@"))
    event, calendar = series_of(F.substring_index(id_, "@", 1)), F.when(has_calendar, F.regexp_replace(id_, "(?s)^[^@]*@", "")).otherwise(PRIMARY)
    problem = (
        F.when((source == "notion") & hexed.isNull(), F.lit("not a page id"))
        .when((source == "gdocs") & ~doc.rlike(FILE_ID), F.lit("not a file id"))
        .when((source == "gdocs") & has_tab & ~tab.rlike(TAB_ID), F.lit("not a tab id"))
        .when((source == "calendar") & ~event.rlike(EVENT_ID), F.lit("not an event id"))
        .when((source == "calendar") & (calendar == ""), F.lit("no calendar id"))
    )
    known = source.isin("notion", "gdocs", "calendar")
    found = F.when(source == "notion", hexed).when(source == "gdocs", id_).when(source == "calendar", calendar_id(event, calendar))
    return F.struct(F.when(known & problem.isNull(), source).alias("source"), F.when(known & problem.isNull(), found).alias("id"), F.when(known, problem).alias("problem"))


def page_id_of_url(path: Column) -> Column:
    """The last page id in a URL's path."""
    return F.lower(F.replace(F.element_at(F.regexp_extract_all(path, F.lit(HEX_IN_PATH), F.lit(0)), -1), F.lit("-"), F.lit("")))


def _after(parts: Column, word: str) -> Column:
    return F.get(parts, F.array_position(parts, word).cast("int"))


def _parameter(query: Column, name: str) -> Column:
    return F.regexp_extract(F.coalesce(query, F.lit("")), f"(?:^|&){name}=([^&]*)", 1)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def file_id_of_url(path: Column, query: Column) -> Column:
    """The id behind `d` or `folders`, or the `id` parameter of an `open` link; `/u/<n>` is skipped."""

    def found(parts: Column) -> Column:
        return F.when(F.array_contains(parts, "d"), _after(parts, "d")).when(F.array_contains(parts, "folders"), _after(parts, "folders")).when(F.array_contains(parts, "open"), _parameter(query, "id"))

    return let(let(_segments(F.regexp_replace(path, r"/u/\d+(?=/|$)", "")), found), lambda x: F.when(x.rlike(FILE_ID), x))


def event_of_url(path: Column, query: Column) -> Column:
    """The canonical calendar id in an `eid`: unpadded base64url of `<event> <calendar>`."""
    token = let(_segments(path), lambda p: F.when(F.array_contains(p, "eventedit"), _after(p, "eventedit")).otherwise(_parameter(query, "eid")))
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    padded = lambda x: F.concat(x, F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4))))
    decoded = let(plain, lambda x: F.when(x.rlike("^[A-Za-z0-9+/]+$") & (F.pmod(F.length(x), F.lit(4)) != 1), F.decode(F.unbase64(padded(x)), "ISO-8859-1")))

    def canonical(text: Column) -> Column:
        event, calendar = series_of(F.substring_index(text, " ", 1)), F.regexp_replace(text, "(?s)^[^ ]* ?", "")
        return F.when(F.contains(text, F.lit(" ")) & (calendar != "") & event.rlike(EVENT_ID), calendar_id(event, calendar))

    return let(decoded, canonical)


def parse_url(url: Column) -> Column:
    """struct(source, id) of a page, file or event URL, by its host; nulls for other URLs."""
    parts = F.struct(
        F.lower(F.regexp_extract(url, r"(?i)^\s*https?://(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1)).alias("host"),
        F.regexp_extract(url, r"(?i)^\s*https?://[^/?#\s]+([^?#\s]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#\s]*)", 1).alias("query"),
    )

    def of(u: Column) -> Column:
        host = u["host"]
        kind = (
            F.when(host.isin("notion.so", "www.notion.so", "notion.com", "www.notion.com", "app.notion.com") | F.endswith(host, F.lit(".notion.site")), "notion")
            .when(host.isin("docs.google.com", "drive.google.com"), "gdocs")
            .when(host == "calendar.google.com", "calendar")
        )
        id_ = F.when(kind == "notion", page_id_of_url(u["path"])).when(kind == "gdocs", file_id_of_url(u["path"], u["query"])).when(kind == "calendar", event_of_url(u["path"], u["query"]))
        return F.struct(kind.alias("source"), id_.alias("id"))

    found = let(F.when(F.trim(url).rlike(r"(?i)^https?://\S+$"), parts), of)
    return let(found, lambda r: F.struct(F.when(r["id"].isNotNull(), r["source"]).alias("source"), r["id"].alias("id")))


def format_ref(source: Column, id_: Column) -> Column:
    return F.concat(source, F.lit(":"), id_)


def doc_of(id_: Column) -> Column:
    """The document of a document or tab id."""
    return F.substring_index(id_, "#", 1)


def tab_of(id_: Column) -> Column:
    return F.when(F.contains(id_, F.lit("#")), F.regexp_replace(id_, "(?s)^[^#]*#", ""))


def open_url(source: Column, id_: Column, mime: Column) -> Column:
    """Where a person opens the object."""
    kind = F.create_map(*(F.lit(x) for k, v in {"document": "document", "spreadsheet": "spreadsheets", "presentation": "presentation", "drawing": "drawings"}.items() for x in (f"application/vnd.google-apps.{k}", v)))[mime]
    event, calendar = series_of(F.substring_index(id_, "@", 1)), F.when(F.contains(id_, F.lit("@")), F.regexp_replace(id_, "(?s)^[^@]*@", "")).otherwise(PRIMARY)
    token = F.regexp_replace(F.translate(F.base64(F.encode(F.concat(event, F.lit(" "), calendar), "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    return (
        F.when(source == "notion", F.concat(F.lit("https://www.notion.so/"), id_))
        .when(source == "calendar", F.concat(F.lit("https://calendar.google.com/calendar/event?eid="), token))
        .when(mime == "application/vnd.google-apps.folder", F.concat(F.lit("https://drive.google.com/drive/folders/"), id_))
        .when(tab_of(id_).isNotNull(), F.concat(F.lit("https://docs.google.com/document/d/"), doc_of(id_), F.lit("/edit?tab="), tab_of(id_)))
        .when(kind.isNotNull(), F.concat(F.lit("https://docs.google.com/"), kind, F.lit("/d/"), doc_of(id_), F.lit("/edit")))
        .otherwise(F.concat(F.lit("https://drive.google.com/file/d/"), doc_of(id_), F.lit("/view")))
    )


def split_spec(spec: Column) -> Column:
    """struct(text, alias): cut at the last `=` unless that belongs to a query or fragment parameter."""
    text = F.regexp_extract(spec, r"(?s)^(.*)=[^=]*$", 1)
    cut = F.contains(spec, F.lit("=")) & ~text.rlike(r"[?&#][^=?&#]*$")
    return F.struct(F.when(cut, text).otherwise(spec).alias("text"), F.when(cut, F.regexp_extract(spec, r"(?s)=([^=]*)$", 1)).alias("alias"))

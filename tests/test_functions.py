"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from doclens.functions import paths, refs, text


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("title", "ext", "name"),
    [
        ("CON", ".md", "CON-.md"),
        ("con.x", ".md", "con-.x.md"),
        ("a/b:c", ".md", "a-b-c.md"),
        (" .x. ", ".md", "x.md"),
        ("", ".md", "untitled.md"),
        (". . .", "", "untitled"),
        ("漢" * 100, ".md", "漢" * 65 + ".md"),
        ("console", ".md", "console.md"),
    ],
)
def test_file_name(value, title, ext, name):
    assert value(paths.file_name(F.lit(title), F.lit(ext))) == name


def test_nfc_names(value):
    assert value(paths.file_name(text.nfc(F.lit("e\u0301")), F.lit(".md"))) == "é.md"


@pytest.mark.parametrize(("path", "own"), [("specs/", "specs"), ("specs/auth.md", "specs/auth"), (".hidden", ".hidden"), ("a.b/c", "a.b/c"), ("a/b.tar.gz", "a/b.tar"), ("x/.h", "x/.h")])
def test_territory(value, path, own):
    assert value(paths.territory_of(F.lit(path))) == own


def test_under_root(value):
    under = lambda r, p: value(paths.is_under_root(F.lit(r), F.lit(p)))
    assert under("specs/auth.md", "specs/auth.md")
    assert under("specs/auth.md", "specs/auth/x.md")
    assert not under("specs/auth.md", "specs/authx.md")
    assert not under("Specs/", "specs/a.md")


@pytest.mark.parametrize(
    ("path", "problem"),
    [("", "empty path"), ("/a.md", "absolute path"), ("a\\b.md", "backslash"), ("a//b.md", "empty segment"), ("a/./b.md", "dot segment"), ("../a.md", "parent segment"), (".a/b.md", "hidden segment"), ("a/b", "no extension"), ("a/b/", None), ("a.md", None)],
)
def test_path_problem(value, path, problem):
    assert value(paths.path_problem(F.lit(path))) == problem


@pytest.mark.parametrize(("a", "b", "relative"), [("a/b/c.md", "a/d.md", "../d.md"), ("x.md", "y/z.md", "y/z.md"), ("a/x.md", "a/y.md", "y.md"), ("a/b.md", "b.md", "../b.md"), ("a/b/c.md", "a/b", "../b")])
def test_relative_paths_resolve(value, a, b, relative):
    assert value(paths.relative_path(F.lit(a), F.lit(b))) == relative
    assert value(paths.resolve_path(F.lit(a), F.lit(relative))) == b


def test_paths_of_a_document(value):
    assert value(paths.extension_of(F.lit("a.b/.x"))) == ""
    assert value(paths.extension_of(F.lit("a/b.tar.gz"))) == ".gz"
    assert value(paths.stem_of(F.lit("a/b.tar.gz"))) == "a/b.tar"
    assert value(paths.sidecar_path(F.lit("a/b.md"))) == "a/b.comments.md"
    assert not value(paths.is_sidecar(F.lit(".comments.md")))
    assert value(paths.asset_document(F.lit("a/b.assets/x.png"))) == "a/b.md"
    assert value(paths.asset_document(F.lit("a/.assets/x.png"))) is None
    assert value(paths.asset_document(F.lit("assets/x.png"))) is None
    assert value(paths.is_inside(F.lit("a/b.md")))
    assert not value(paths.is_inside(F.lit("C:/b.md")))


HEX = "0123456789abcdef0123456789ABCDEF"
DASHED = "01234567-89ab-cdef-0123-456789abcdef"


@pytest.mark.parametrize(
    ("given", "source", "id_", "problem"),
    [
        (f"notion:{HEX}", "notion", HEX.lower(), None),
        (f" notion:{DASHED} ", "notion", HEX.lower(), None),
        ("notion:abc", None, None, "not a page id"),
        (f"gdocs:{HEX}#t.x1", "gdocs", f"{HEX}#t.x1", None),
        (f"gdocs:{HEX}#x", None, None, "not a tab id"),
        (f"gdocs:{HEX}#t.1#t.2", None, None, "not a tab id"),
        ("calendar:abcde_2026", "calendar", "abcde", None),
        ("calendar:abcde@me@x.org", "calendar", "abcde@me@x.org", None),
        ("calendar:abcde@primary", "calendar", "abcde", None),
        ("calendar:wxyz1@", None, None, "not an event id"),
        ("other:abc", None, None, None),
        ("https://x.org/a", None, None, None),
    ],
)
def test_literal_refs(value, given, source, id_, problem):
    found = value(refs.parse_literal(F.lit(given)))
    assert (found["source"], found["id"], found["problem"]) == (source, id_, problem)


@pytest.mark.parametrize(
    ("url", "source", "id_"),
    [
        (f"https://www.notion.so/x/{HEX}-T-{DASHED}?v={HEX}#{HEX}", "notion", HEX.lower()),
        (f"https://me.notion.site/T-{HEX}", "notion", HEX.lower()),
        (f"https://docs.google.com/document/u/0/d/{HEX}/edit", "gdocs", HEX),
        (f"https://drive.google.com/drive/u/1/folders/{HEX}", "gdocs", HEX),
        (f"https://drive.google.com/open?usp=x&id={HEX}", "gdocs", HEX),
        ("https://docs.google.com/document/d/short", None, None),
        ("https://calendar.google.com/calendar/event?eid=YWJjZGVfMjAyNiBtZUB4Lm9yZw", "calendar", "abcde@me@x.org"),
        ("https://calendar.google.com/calendar/u/0/r/eventedit/YWJjZGUgcHJpbWFyeQ", "calendar", "abcde"),
        ("https://calendar.google.com/x?eid=%%%", None, None),
        (f"ftp://www.notion.so/{HEX}", None, None),
        ("https://x.org/", None, None),
    ],
)
def test_urls(value, url, source, id_):
    found = value(refs.parse_url(F.lit(url)))
    assert (found["source"], found["id"]) == (source, id_)


def test_open_url_and_spec(value):
    at = lambda *x: value(refs.open_url(*(F.lit(v).cast("string") for v in x)))
    assert at("calendar", "abcde", None).endswith("eid=YWJjZGUgcHJpbWFyeQ")
    assert at("gdocs", "d#t.1", None) == "https://docs.google.com/document/d/d/edit?tab=t.1"
    assert at("gdocs", "d", "application/vnd.google-apps.folder") == "https://drive.google.com/drive/folders/d"
    spec = lambda x: tuple(value(refs.split_spec(F.lit(x))))
    assert spec("notion:a=b/c.md") == ("notion:a", "b/c.md")
    assert spec("https://x.org/?v=1") == ("https://x.org/?v=1", None)
    assert spec("https://x.org/?v=1=p/") == ("https://x.org/?v=1", "p/")


def test_text(value):
    lit = F.lit
    assert value(text.utf16_len(lit("a💡é"))) == 4
    assert value(text.minute(lit("2026-09-03T07:55:12.165Z"))) == "2026-09-03 07:55"
    assert value(text.minute(lit("soon"))) == "soon"
    assert value(text.local_minute(lit("2026-09-03T23:30:00Z"), "Europe/Paris")) == "2026-09-04 01:30"
    assert value(text.decode_entities(lit("&amp;lt; &lt;b&gt;"))) == "&lt; <b>"
    assert value(text.shorten(lit("x" * 70))) == "x" * 59 + "…"
    assert value(text.occurrences_before(lit("aXaXa"), lit("a"), lit(2))) == 1
    assert value(text.blank_line(lit("a\nfetched: 1\nfetched: 2"))) == "a\nfetched:\nfetched: 2"
    assert value(text.quoted(lit("a\n\nb"))) == "> a\n>\n> b"
    assert value(text.wall_stamp(lit("2026-09-03T09:05:00+02:00"))) == "2026-09-03 0905"
    assert value(text.plural(lit(1), "file")) == "1 file"

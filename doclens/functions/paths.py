"""Column functions on paths: territories, validity, names derived from titles, relative paths, assets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions.text import let

SIDECAR, ASSETS = ".comments.md", ".assets"
#: Characters that no file name may hold, and device names.
FORBIDDEN = r'[/\\:*?"<>|\x00-\x1f\x7f]'
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"
NAME_BYTES = 200
EDGES = r"[\s   -     　﻿.]"


def territory_of(path: Column) -> Column:
    """The directory a root owns: itself, or for a file its sibling of the same stem."""
    return F.when(F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(F.regexp_replace(path, r"(?s)^((?:.*/)?[^/]+)\.[^./]*$", "$1"))


def is_under_root(root: Column, path: Column) -> Column:
    """The root itself, its territory, or anything in it; case counts."""
    own = territory_of(root)
    return (path == root) | (path == own) | F.startswith(path, F.concat(own, F.lit("/")))


def is_read_only(read_only: Column, source: Column) -> Column:
    return F.coalesce(read_only, F.lit(False)) | (source == "calendar")


def path_problem(path: Column) -> Column:
    """The first rule that a path breaks, or null."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    last = F.element_at(parts, -1)
    each = F.filter(F.transform(parts, lambda s: F.when(s == "", F.lit("empty segment")).when(s == ".", F.lit("dot segment")).when(s == "..", F.lit("parent segment")).when(F.startswith(s, F.lit(".")), F.lit("hidden segment"))), lambda m: m.isNotNull())
    return (
        F.when(path == "", F.lit("empty path"))
        .when(F.startswith(path, F.lit("/")), F.lit("absolute path"))
        .when(F.contains(path, F.lit("\\")), F.lit("backslash"))
        .when(F.size(each) > 0, F.get(each, F.lit(0)))
        .when(~F.endswith(path, F.lit("/")) & ~F.contains(last, F.lit(".")), F.lit("no extension"))
    )


def is_inside(path: Column, own_dir: str = ".doclens") -> Column:
    """Whether a path names something in the checkout, other than the engine's own folder."""
    parts = F.split(path, "/")
    bad = path.isin("", ".", "./") | F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("./")) | path.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (parts[0] == own_dir)
    return ~bad


def trim_edges(text: Column) -> Column:
    """Without white space and dots at both ends, in any order."""
    return F.regexp_replace(text, f"^{EDGES}+|{EDGES}+$", "")


def cut_bytes(text: Column, limit: Column) -> Column:
    """At most `limit` UTF-8 bytes, never inside a character."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(text), F.greatest(limit, F.lit(0)))), lambda n: F.octet_length(F.left(text, n)) <= limit)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.left(text, F.array_max(fits)))


def file_name(title: Column, ext: Column) -> Column:
    """A safe file name for a title in normal form C; the extension is appended as it is."""
    named = lambda x: F.when(x == "", F.lit("untitled")).otherwise(x)
    stem = F.regexp_replace(trim_edges(F.regexp_replace(title, FORBIDDEN, "-")), DEVICES, "$1-$2")
    room = F.lit(NAME_BYTES) - F.octet_length(ext)
    cut = let(let(stem, named), lambda s: trim_edges(cut_bytes(s, room)))
    return F.concat(let(cut, named), ext)


def resolve_alias(alias: Column, title: Column, container: Column, ext: Column) -> Column:
    """struct(path, problem): where an object lands that is added under an alias."""
    prefix = F.coalesce(alias, F.lit(""))
    last = F.element_at(F.split(prefix, "/"), -1)
    names_file = F.contains(last, F.lit(".")) & ~F.startswith(last, F.lit("."))
    under = (prefix == "") | F.endswith(prefix, F.lit("/"))
    derived = F.concat(prefix, F.when(container, F.concat(file_name(title, F.lit("")), F.lit("/"))).otherwise(file_name(title, ext)))
    path = F.when(under, derived).when(container, F.concat(prefix, F.lit("/"))).otherwise(prefix)
    clash = F.when(~under & container & names_file, F.lit("a folder cannot be a file")).when(~under & ~container & ~names_file, F.lit("a document needs an extension"))
    problem = F.coalesce(clash, path_problem(path))
    return F.struct(F.when(problem.isNull(), path).alias("path"), problem.alias("problem"))


def parents(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def relative_path(source: Column, target: Column) -> Column:
    """From the folder of one file to another file."""
    a, b = parents(source), F.split(target, "/")
    most = F.least(F.size(a), F.size(b) - 1)
    shared = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), most), lambda i: (i >= most) | ~(F.get(a, i).eqNullSafe(F.get(b, i))))), F.lit(0))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b) - shared)), "/")


def resolve_path(source: Column, relative: Column) -> Column:
    """A relative link from a file; surplus `..` are ignored."""
    steps = F.filter(F.split(relative, "/"), lambda s: ~s.isin("", "."))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    return F.array_join(F.aggregate(steps, parents(source), lambda acc, s: F.when(s == "..", up(acc)).otherwise(F.concat(acc, F.array(s)))), "/")


def extension_of(path: Column) -> Column:
    """With its dot; a leading dot is no extension."""
    return F.regexp_extract(path, r"(?s)(?:^|/)[^/]+(\.[^./]*)$", 1)


def stem_of(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(extension_of(path)))


def sidecar_path(path: Column) -> Column:
    return F.concat(F.left(path, F.length(path) - 3), F.lit(SIDECAR))


def is_sidecar(path: Column) -> Column:
    return F.endswith(path, F.lit(SIDECAR)) & (F.length(path) > len(SIDECAR))


def assets_dir(path: Column) -> Column:
    return F.concat(stem_of(path), F.lit(ASSETS))


def asset_document(path: Column) -> Column:
    """The document whose assets a path holds, or null: the first folder `<stem>.assets` counts."""
    at = F.instr(path, f"{ASSETS}/")
    folder = F.left(path, at - 1)
    return F.when((at > 1) & ~F.endswith(folder, F.lit("/")), F.concat(folder, F.lit(".md")))


def last_url_segment(url: Column) -> Column:
    segment = F.element_at(F.split(F.regexp_replace(url, "(?s)[?#].*$", ""), "/"), -1)
    return F.when(segment != "", F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment))


#: Content types of assets and the extension each takes.
MIME_EXTENSIONS = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "application/pdf": ".pdf",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "video/mp4": ".mp4",
    "audio/mpeg": ".mp3",
}


def mime_of(path: Column) -> Column:
    """The content type of a file by its extension, letter case aside; bytes where it is another or none."""
    by_ext = F.create_map(*(F.lit(x) for mime, ext in MIME_EXTENSIONS.items() for x in (ext, mime)))
    return F.coalesce(F.try_element_at(by_ext, F.lower(extension_of(path))), F.lit("application/octet-stream"))


def asset_hint(name: Column, url: Column, content_type: Column, position: Column) -> Column:
    """struct(title, ext): what a hosted file wants to be called."""
    by_type = F.create_map(*(F.lit(x) for pair in MIME_EXTENSIONS.items() for x in pair))
    typed = F.coalesce(F.element_at(by_type, F.lower(F.trim(F.split(content_type, ";")[0]))), F.lit(""))
    raw = F.coalesce(name, last_url_segment(url), F.lit(""))
    ext = extension_of(raw)
    title = F.when(raw == "", F.concat(F.lit("image-"), F.coalesce(position, F.lit(1)).cast("string"))).otherwise(F.left(raw, F.length(raw) - F.length(ext)))
    return F.struct(title.alias("title"), F.when((raw == "") | (ext == ""), typed).otherwise(ext).alias("ext"))

"""Files that documents hold: which moved, what may be uploaded, where links point, what is carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.paths import relative_path

#: The largest file a block takes and the largest image a text document takes, in bytes.
BLOCK_MOST, IMAGE_MOST = 5 << 30, 5 << 20


def asset_moved(old_path: Column, path: Column, old_mark: Column, mark: Column) -> Column:
    """Missing before, elsewhere now, or with another time or checksum; a signed URL is no mark."""
    return old_path.isNull() | (old_path != path) | ~old_mark.eqNullSafe(mark)


def moved_assets(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current (id, path, mark) rows that have to be read again."""
    old = previous.select("id", F.col("path").alias("_path"), F.col("mark").alias("_mark"))
    return current.join(old, "id", "left").where(asset_moved(F.col("_path"), F.col("path"), F.col("_mark"), F.col("mark"))).select(*current.columns)


def upload_verdict(source: Column, size: Column, mime: Column) -> Column:
    """Null where a file can be uploaded, else why it is skipped."""
    image = F.startswith(mime, F.lit("image/"))
    return (
        F.when(size == 0, "empty file")
        .when((source == "notion") & (size > BLOCK_MOST), "too large for a block")
        .when((source == "gdocs") & ~image, "a text document takes images only")
        .when((source == "gdocs") & (size > IMAGE_MOST), "too large for an image")
    )


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links (path, target_id, url) with `href`: the relative path of a page that is checked out, else the URL."""
    known = pages.select(F.col("id").alias("target_id"), F.col("path").alias("_to"))
    return links.join(known, "target_id", "left").withColumn("href", F.coalesce(relative_path(F.col("path"), F.col("_to")), F.col("url"))).drop("_to")


def carry_over(unread: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows of documents that were not read again: the document's own, and its assets and tabs."""
    ids = unread.select(F.col("id").alias("document"))
    owner = F.coalesce(F.col("document"), F.substring_index("id", "#", 1))
    return index.withColumn("_owner", owner).join(ids.select(F.col("document").alias("_owner")), "_owner", "left_semi").drop("_owner")


def assets_of(live: DataFrame, index: DataFrame, gone: DataFrame) -> DataFrame:
    """document, assets: the files that a pushed document has — touched or indexed, but not removed."""
    every = live.select("document", "path").unionByName(index.where("type = 'asset'").select("document", "path"))
    left = every.join(gone.select("path"), "path", "left_anti")
    return left.groupBy("document").agg(F.sort_array(F.collect_set("path")).alias("assets"))


def hosted(blocks: DataFrame, kinds: tuple[str, ...] = ("image", "file", "pdf", "video", "audio")) -> DataFrame:
    """Blocks that hold a file, numbered in document order."""
    from pyspark.sql import Window

    return blocks.where(F.col("type").isin(*kinds)).withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))


def rename_wanted(old_path: Column, path: Column, title: Column, source_title: Column) -> Column:
    """The file moved, or its front matter names another title than the source has."""
    return F.coalesce(old_path != path, F.lit(False)) | F.coalesce(title != source_title, F.lit(False))

"""Names under which SQL can call what has no built-in."""

from __future__ import annotations

from pyspark.sql import SparkSession

from doclens.functions.text import nfc
from doclens.operators.diff import text_diff


def register(spark: SparkSession) -> None:
    """nfc(text), text_diff(a, b) and the table function markdown_blocks(text) for spark.sql()."""
    from doclens.operators.blocks import MarkdownBlocks

    spark.udf.register("nfc", nfc)
    spark.udf.register("text_diff", text_diff)
    spark.udtf.register("markdown_blocks", MarkdownBlocks)

"""Tables between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed now and written in the shared folder of the session's checkpoints, so that no later round computes it
    again; a folder of our own serves only where executors are threads of this machine."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: iterative operators need a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="doclens-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()

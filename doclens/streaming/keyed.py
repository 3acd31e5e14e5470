"""Changes of a stream of listings as keyed state: a row for each object, a timer for those that stop coming.

The state of an object is what was last listed of it. It grows with the objects that there are, not with the listings,
is partitioned by object and kept in the query's checkpoint; no snapshot is written again for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "id string, change string, time string, md5 string, seen timestamp"
STATE = "time string, md5 string, seen long"


def listing_changes(listings: DataFrame, every_ms: int) -> DataFrame:
    """id, change (added, modified, deleted), time, md5, seen, for a stream of rows (id, time, md5, seen).

    All rows of a listing have its time in `seen`, in milliseconds apart; listings come every `every_ms` at most. An object
    is added where nothing is known of it, modified where its time or md5 is another, and deleted where the next
    listing does not have it: its timer fires once a later listing has moved the watermark, or its own row, if it
    comes back after a listing without it, says deleted first. `seen` of a deletion is when it was listed last.

    Rows of a listing older than what is known of their object change nothing; null ids are no objects.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        out = []
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        if state.hasTimedOut:
            out.append((key[0], "deleted", known[0], known[1], at(known[2])))
            state.remove()
        else:
            rows = pd.concat(batches)
            rows["ms"] = rows["seen"].astype("datetime64[ms]").astype("int64")
            for time, md5, ms in rows.sort_values(["ms", "time", "md5"], na_position="first")[["time", "md5", "ms"]].itertuples(index=False):
                time, md5 = (None if pd.isna(x) else x for x in (time, md5))
                if known is not None and ms <= known[2]:
                    continue
                if known is not None and ms - known[2] > every_ms:
                    out.append((key[0], "deleted", known[0], known[1], at(known[2])))
                    known = None
                if known is None or (time, md5) != known[:2]:
                    out.append((key[0], "added" if known is None else "modified", time, md5, at(ms)))
                known = (time, md5, ms)
            state.update(known)
            state.setTimeoutTimestamp(max(known[2] + every_ms - 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    # of rows that a listing repeats, the last by time and md5
    rows = listings.where("id is not null").select(F.col("id").cast("string").alias("id"), "time", "md5", "seen").withWatermark("seen", "0 seconds")
    return rows.groupBy("id").applyInPandasWithState(follow, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)

"""Changes from keyed state against the differences of one listing and the next."""

import random
from datetime import datetime, timedelta

from doclens.operators import snapshot
from doclens.streaming.keyed import listing_changes

HOUR = timedelta(hours=1)
START = datetime(2024, 1, 1)


def test_changes_equal_those_of_whole_listings(spark, tmp_path):
    rng = random.Random(5)
    known, listings = {}, []
    for _ in range(7):
        for id_ in range(25):
            if rng.random() < 0.25:
                known[f"d{id_}"] = (f"t{rng.randrange(3)}", rng.choice([None, "a", "b"]))
            elif rng.random() < 0.25:
                known.pop(f"d{id_}", None)
        listings.append(dict(known))
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id string, time string, md5 string, seen timestamp"

    def listed(rows, seen):
        spark.createDataFrame([(i, *x, seen) for i, x in rows.items()], schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        listing_changes(stream, 3_600_000).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for n, rows in enumerate(listings):
        listed(rows, START + n * HOUR)
        if n == 4:
            listed({"d1": ("late", "late"), "d77": ("late", "late")}, START + 1 * HOUR)  # of a listing that is over
        if n in (2, 4):  # a query that ends here and starts again
            run()
    listed({"end": ("t", "m")}, START + 7 * HOUR)
    listed({"end": ("t", "m")}, START + 8 * HOUR)
    run()
    found = sorted((r["id"], r["seen"], r["change"]) for r in spark.read.parquet(sink).collect() if r["id"] != "end")
    row = "id string, time string, md5 string"
    expected = []
    for n in range(len(listings) + 1):
        cur, prev = (spark.createDataFrame([(i, *x) for i, x in rows.items()], row) for rows in (listings[n] if n < len(listings) else {}, listings[n - 1] if n else {}))
        expected += [(r["id"], START + n * HOUR, r["change"]) for r in snapshot.changes_since(cur, prev).collect()]
        expected += [(r["id"], START + (n - 1) * HOUR, "deleted") for r in snapshot.gone(cur, prev).collect()]
    assert found == sorted(expected)
    assert {c for *_, c in found} == {"added", "modified", "deleted"}

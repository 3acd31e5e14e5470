"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle is a run of frames with a seek table of the
seekable Zstandard format in a skippable footer frame, and an index maps record identifiers to a frame and an offset
in it. Tasks write bundles of bounded size in the shared folder under a name of their own attempt, so that a task that
runs again leaves its old file unread; readers get the list of bundles from the rows of the tasks that finished.

Equal payloads from `revisit_bytes` on are stored once: the record with the largest id is the response, the others
are revisits that refer to it. They are found by fingerprints alone; payloads are written by the tasks that read them.

Reading goes by the index: a task gets the places of a bundle's records, opens the frames that hold some, and takes
each record at its offset in its frame. A part of the index reads that part of the records.

Defined results: null html has the empty payload; ids must not be null (null ids are written as record 'null' and
come back null); repeated rows are records of their own (rows that repeat the largest id are all responses); an empty
table writes no bundle and gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import Scratch, build_bloom, lean, quoted, sieve

#: Fixed values of the seekable format: skippable frame magic, footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "bundle string, record_id string, id long, frame int, at long, length long"
RECORDS = "id long, record_type string, refers_to long, payload_bytes long, payload_digest string, uri string, payload binary"


class BundleWriter:
    """Frames of about `frame_bytes` and a seek table behind them."""

    def __init__(self, frame_bytes: int, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.written = bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in the frame of the record."""
        if self.open and len(self.open) + len(record) > self.frame_bytes:
            self.close_frame()
        place = (len(self.frames), len(self.open))
        self.open += record
        self.written += len(record)
        return place

    def close_frame(self) -> None:
        if self.open:
            packed = self.compressor.compress(bytes(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class BundleReader:
    """Frames of a bundle by number, through its seek table; only the frames asked for are read."""

    def __init__(self, source: bytes | pa.NativeFile):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.source.size()
        count, flags, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        width = 12 if flags & 0x80 else 8
        table = self.source.read_at(count * width, size - 9 - count * width)
        self.frames, start = [], 0
        for k in range(count):
            packed, full = struct.unpack_from("<II", table, k * width)
            self.frames.append((start, packed, full))
            start += packed

    def __len__(self) -> int:
        return len(self.frames)

    def frame(self, k: int) -> bytes:
        start, packed, size = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, start), max_output_size=size)

    def record(self, frame: int, at: int, length: int) -> bytes:
        return self.frame(frame)[at : at + length]


def warc_record(id_, uri: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no block but names the payload's digest, length and the record it repeats."""
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if id_ is None else id_}>",
        f"WARC-Target-URI: {(uri or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


#: Groups of equal payloads up to which their table is sent to every task (about 120 bytes each).
BROADCAST_GROUPS = 200_000


def with_revisits(pages: DataFrame, revisit_bytes: int, scratch: Scratch, most_groups: int | None = None) -> DataFrame:
    """pages (id, uri, html) -> with refers_to, null for responses.

    Groups are counted on fingerprints. Where their table is small, pages look it up as they are read; beyond, only
    pages that a filter lets through are joined.
    """
    keyed = pages.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("print", F.sha2(F.encode("html", "UTF-8"), 256))
    groups = keyed.where(F.col("bytes") >= revisit_bytes).groupBy("print", "bytes").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = scratch.table(groups, "groups")
    n_groups = groups.count()
    refers = F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    marked = lambda rows, found: rows.join(found, ["print", "bytes"], "left").select("id", "uri", "html", refers.alias("refers_to"))
    if n_groups <= (BROADCAST_GROUPS if most_groups is None else most_groups):
        return marked(keyed, F.broadcast(groups))
    bloom = build_bloom(groups.select(F.xxhash64("print")), n_groups)
    if bloom is None:
        return marked(keyed, groups)
    hits, rest = sieve(keyed, F.xxhash64("print"), bloom)
    return rest.select("id", "uri", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(marked(hits, groups))


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int, bundle_bytes: int) -> DataFrame:
    """Write (id, uri, html, refers_to) as bundles in `folder`; gives the index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        own, n = f"part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", 0
        writer, index = BundleWriter(frame_bytes), []

        def close():
            name = f"{own}-{n}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(writer.finish())
            columns = list(zip(*index, strict=True))
            return pa.record_batch(
                {
                    "bundle": pa.array([name] * len(index)),
                    "record_id": pa.array(columns[0]),
                    "id": pa.array(columns[1], pa.int64()),
                    "frame": pa.array(columns[2], pa.int32()),
                    "at": pa.array(columns[3], pa.int64()),
                    "length": pa.array(columns[4], pa.int64()),
                }
            )

        for batch in batches:
            for k in range(batch.num_rows):
                id_, uri, html, refers = (c[k].as_py() for c in batch.columns)
                record = warc_record(id_, uri, (html or "").encode(), refers)
                index.append((f"urn:page:{'null' if id_ is None else id_}", id_, *writer.add(record), len(record)))
                if writer.written >= bundle_bytes:
                    yield close()
                    writer, index, n = BundleWriter(frame_bytes), [], n + 1
        if index:
            yield close()

    return pages.select("id", "uri", "html", "refers_to").mapInArrow(lean(run), INDEX)


def read_records(folder: str, index: DataFrame, n_tasks: int, payload: bool = True) -> DataFrame:
    """The records that the index rows name, taken at their places; digests are checked. A bundle is the unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        number = lambda x: None if x[10:-1] == "null" else int(x[10:-1])
        for batch in batches:
            for name, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    reader = BundleReader(source)
                    by_frame: dict[int, list[tuple[int, int]]] = {}
                    for place in places.as_py():
                        by_frame.setdefault(place["frame"], []).append((place["at"], place["length"]))
                    for frame in sorted(by_frame):
                        data, rows = reader.frame(frame), []
                        for at, length in by_frame[frame]:
                            [(head, block)] = parse_records(data[at : at + length])
                            kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                                raise ValueError(f"{name}: {head['warc-record-id']} does not have its digest")
                            rows.append((number(head["warc-record-id"]), kind, number(head.get("warc-refers-to", "<urn:page:null>")), int(head["x-payload-length"]), digest, head["warc-target-uri"], block if payload and kind == "response" else None))
                        columns = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    # a bundle's size bounds its records; the number of tasks is given, so that adaptive execution does not merge them
    places = index.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "at", "length"))).alias("places"))
    return places.repartition(max(1, n_tasks)).mapInArrow(lean(run), RECORDS)


def archive(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, frame_bytes: int = 256 << 10, bundle_bytes: int = 16 << 20, most_groups: int | None = None) -> dict:
    """Write all pages and give {folder, index, bundles, records}: the index as a table, how many bundles there are, the
    records as read back."""
    scratch = Scratch(pages.sparkSession, "warc")
    plain = pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(uri_col)).cast("string").alias("uri"), F.coalesce(F.col(quoted(html_col)), F.lit("")).alias("html"))
    folder = scratch.path("bundles")
    index = scratch.table(write_bundles(with_revisits(plain, revisit_bytes, scratch, most_groups), folder, frame_bytes, bundle_bytes), "index")
    n_bundles = index.select("bundle").distinct().count()
    return {"folder": folder, "index": index, "bundles": n_bundles, "records": read_records(folder, index, min(n_bundles, 50_000))}

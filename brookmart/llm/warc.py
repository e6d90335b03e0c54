"""WARC records in seekable Zstandard bundles: independent frames, an index, a footer seek table, random access.

Bundle layout: data frames; one skippable frame with the index (record id, frame, offset inside the frame, length);
one skippable frame in the public seekable format (sizes of each frame, then count, flags and magic number).
Defined results: a null payload counts as empty; payloads under `least` bytes are always responses; of equal longer
payloads one row with the smallest id is the response, all others are revisits without a body. Null ids come after all
others: rows without one revisit the smallest id, or, if their payload has no other row, one of them; repeated rows are
all kept, and the first of an id answers a look-up; an empty table gives no bundle; other columns aren't read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Uncompressed bytes after which a frame, and after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23


#: Date of records whose table has no date of capture.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit has the payload's digest and size in its header and no body."""
    revisit = refers_to is not None if revisit is None else revisit
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "").replace("\r", " ").replace("\n", " "), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record; ValueError if it is cut or not a record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut")
    return fields, rest[:size]


def bundle(frames: list[list[tuple[int, bytes]]], level: int = 3) -> bytes:
    packer, out, table, index = zstandard.ZstdCompressor(level=level), [], [], []
    for n, records in enumerate(frames):
        at = 0
        for key, data in records:
            index.append((key, n, at, len(data)))
            at += len(data)
        packed = packer.compress(b"".join(d for _, d in records))
        out.append(packed)
        table.append((len(packed), at))
    body = packer.compress(json.dumps(index).encode())
    out.append(struct.pack("<II", SKIPPABLE, len(body)) + body)
    seek = b"".join(struct.pack("<II", *x) for x in table) + struct.pack("<IBI", len(table), 0, SEEKABLE)
    return b"".join(out) + struct.pack("<II", SKIPPABLE, len(seek)) + seek


class Bundle:
    """Random access: one look in the footer, then only the frame that holds the record is unpacked."""

    def __init__(self, data: bytes):
        count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        start = len(data) - 9 - 8 * count
        if struct.unpack_from("<II", data, start - 8) != (SKIPPABLE, 8 * count + 9):
            raise ValueError("bad seek table")
        self.data, self.frames, at = data, [], 0
        for n in range(count):
            packed, size = struct.unpack_from("<II", data, start + 8 * n)
            self.frames.append((at, packed, size))
            at += packed
        magic, size = struct.unpack_from("<II", data, at)
        if magic != SKIPPABLE or at + 8 + size != start - 8:
            raise ValueError("bad index")
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = [tuple(x) for x in json.loads(self.unpacker.decompress(data[at + 8 : at + 8 + size]))]
        self.open = (-1, b"")

    def at(self, frame: int, offset: int, size: int) -> tuple[dict[str, str], bytes]:
        if self.open[0] != frame:
            start, packed, full = self.frames[frame]
            self.open = frame, self.unpacker.decompress(self.data[start : start + packed], max_output_size=full)
        return parse(self.open[1][offset : offset + size])

    def get(self, key: int) -> tuple[dict[str, str], bytes]:
        return self.at(*next(x[1:] for x in self.index if x[0] == key))

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        for key, *place in self.index:
            yield key, *self.at(*place)


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows of id, digest, refers_to that revisit another id; ids and digests of rows that repeat). Digests come first, so
    that only (id, digest) pairs are grouped, never payloads."""
    digests = pages.select(key, F.sha2(common.utf8(payload), 256).alias("digest"), F.octet_length(common.utf8(payload)).alias("size"))
    long = common.written(digests.where(F.col("size") >= least).groupBy(key, "digest").agg(F.count(F.lit(1)).alias("rows")), "digests")
    first = long.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = long.join(first.select("digest", "first"), "digest").where(~F.col(key).eqNullSafe(F.col("first")))
    return found.select(key, "digest", F.col("first").alias("refers_to")), long.where("rows > 1").select(key, "digest")


def write_bundles(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 100, date: str | None = None,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle_id, n_records, archive), written to shared storage. Only the ids of revisits are joined to the pages. `date`
    names a column with the text of WARC-Date."""
    common.small_batches(pages.sparkSession)
    again, repeated = revisits(pages, key, payload, least)
    text = lambda c: F.col(c).cast("string")
    rows = pages.select(text(key).alias("id"), text(url).cast("binary").alias("url"), common.utf8(payload).alias("payload"), F.coalesce(text(date) if date else F.lit(DATE), F.lit(DATE)).cast("binary").alias("date"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("turn", F.lit(1))
    if not repeated.isEmpty():  # of rows that repeat, all but one revisit it
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("id", "digest").orderBy("url")))
    again = again.select(text(key).alias("again_id"), F.col("digest").alias("again"), text("refers_to").alias("refers_to"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again")), "left")
    twin = (F.col("turn") > 1) & (F.octet_length("payload") >= least)
    rows = rows.withColumn("revisit", F.col("again").isNotNull() | twin).withColumn("refers_to", F.coalesce("refers_to", F.when(twin, F.col("id"))))
    rows = rows.select("id", "url", "payload", "digest", "refers_to", "revisit", "date")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames, frame, size, full = [], [], 0, 0
        first = None
        plain = lambda raw: None if raw is None else bytes(raw).decode(errors="replace")  # noqa: E731  headers are text

        def close() -> pd.DataFrame:
            done = [*frames, frame] if frame else frames
            return pd.DataFrame({"bundle_id": [first], "n_records": [sum(map(len, done))], "archive": [bundle(done)]})

        for b in batches:
            for i, u, p, d, to, revisit, day in zip(*(b[c] for c in b.columns), strict=True):
                i = None if i is None or pd.isna(i) else int(i)
                to = None if to is None or pd.isna(to) else int(to)
                first = f"bundle-{i}" if first is None else first
                data = record(i, plain(u), bytes(p), d, to, bool(revisit), plain(day))
                frame.append((i, data))
                size, full = size + len(data), full + len(data)
                if size >= frame_bytes:
                    frames.append(frame)
                    frame, size = [], 0
                if full >= bundle_bytes:
                    yield close()
                    frames, frame, size, full, first = [], [], 0, 0, None
        if first is not None:
            yield close()

    return common.written(rows.mapInPandas(run, "bundle_id string, n_records long, archive binary"), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row per record: id, type, payload digest and size as stored, reference, and the body with its real digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page = lambda x: None if x is None or x[10:-1] == "None" else x[10:-1]  # noqa: E731  <urn:page:N>
        for b in batches:
            for data in b["archive"]:
                yield pd.DataFrame(
                    [(page(f["WARC-Record-ID"]), f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:"),
                      int(f["X-Payload-Length"]), page(f.get("WARC-Refers-To")), body) for _, f, body in Bundle(bytes(data))],
                    columns=["page_id", "record_type", "stored_digest", "stored_bytes", "refers_to", "body"],
                )

    out = bundles.select("archive").mapInPandas(run, "page_id string, record_type string, stored_digest string, stored_bytes long, refers_to string, body binary")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses get digest and size from the body that was read; revisits from their header."""
    back = read_bundles(write_bundles(common.table(spark, sf_dir, "pages")))
    own = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(own, F.octet_length("body")).otherwise(F.col("stored_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("body", 256)).otherwise(F.col("stored_digest")).alias("payload_digest"),
        "record_type", "refers_to")


SQL = {
    "op6_warc_bundles": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest AND d.n >= 100"""
}

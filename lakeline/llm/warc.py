"""WARC archives: one Zstandard frame per record, dictionary in the leading skippable frame.

Each task writes one archive.  It trains a dictionary on the first
``dict_sample_bytes`` of the archive's own records, emits it as a skippable frame
(magic 0x184D2A5D), and compresses every record by itself with that dictionary.
Spark's text writer stores the frames: its line separator is an empty skippable
frame, so a part file is a plain chain of frames that any Zstandard reader takes,
and Spark's commit protocol, on any file system Spark can write, covers lost
executors.  Archives are read back through the ``binaryFile`` source.

Equal payloads: digests are folded per (salt, digest) first, then per digest, and
the answer goes back the same way, so a payload shared by a third of all pages
costs no task more than its share.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.llm.common import hand_down, salt_of, saved

# Fixed values of the formats.
DICT_MAGIC = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARCINFO = b"software: lakeline\r\nformat: WARC File Format 1.1\r\n"
ID = "<urn:lakeline:page:%s>"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
FIELDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def plan_records(pages: DataFrame, min_revisit_bytes: int, archive_bytes: int) -> DataFrame:
    """Rows of pages with payload, digest and refers_to, dealt over archives of about ``archive_bytes``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("salt", salt_of(spark, F.col("page_id"), F.col("url")))
    keys = ["digest", "n_bytes"]
    part = rows.groupBy("salt", *keys).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    part = saved(part, "warc-digests")
    shared = part.where(F.col("n_bytes") >= min_revisit_bytes).groupBy(*keys)
    shared = shared.agg(F.max("top").alias("top"), F.sum("n").alias("n")).where("n > 1").drop("n")
    link = hand_down(shared, keys, part)
    total = part.agg(F.sum(F.col("n") * F.col("n_bytes"))).first()[0] or 0
    files = 1 + int(total) // archive_bytes
    on = ["salt", *keys]
    out = rows.repartition(files, *on).join(link.repartition(files, *on), on, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return out.select("page_id", "url", "payload", "digest", "n_bytes", refers.alias("refers_to"))


def header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def record(page_id, url, payload, digest, n_bytes, refers_to, date) -> bytes:
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", ID % page_id), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is None:
        return header(fields, http + payload)
    return header([*fields, ("WARC-Refers-To", ID % refers_to), ("WARC-Profile", REVISIT_PROFILE)], http)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary, or nothing where there is too little to train on."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b""


def archive_writer(level: int, dict_bytes: int, dict_sample_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, press = [], 0, None

        def start() -> list[bytes]:
            d = trained([r[: 128 << 10] for r in waiting], dict_bytes)
            nonlocal press
            press = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(d) if d else None, write_content_size=True)
            first = [DICT_MAGIC + len(d).to_bytes(4, "little") + d] if d else []
            info = header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:lakeline:archive>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], WARCINFO)
            return [*first, press.compress(info), *map(press.compress, waiting)]

        for batch in batches:
            frames = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rec = record(*row, date)
                if press:
                    frames.append(press.compress(rec))
                    continue
                waiting.append(rec)
                size += len(rec)
                if size >= dict_sample_bytes:
                    frames += start()
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
        if not press and waiting:
            yield pa.RecordBatch.from_arrays([pa.array(start(), pa.binary())], ["frame"])

    return write


def write_warc(
    pages: DataFrame, path: str, min_revisit_bytes: int = 1000, archive_bytes: int = 32 << 20, level: int = 3,
    dict_bytes: int = 64 << 10, dict_sample_bytes: int = 4 << 20, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record per row of pages (page_id, url, html) as archives under ``path``.

    The payload is the html in UTF-8, null counts as empty.  Of equal payloads of
    at least ``min_revisit_bytes`` the row with the largest page_id is a response,
    the others revisit it (no payload stored); smaller payloads are all responses.
    Rows that repeat the largest page_id are all responses, and so is a group of
    null page_ids only.  A null or empty url leaves out WARC-Target-URI; control
    characters in it are percent-encoded.  An empty table writes no record.
    ``dict_sample_bytes`` bounds what the dictionary of an archive is trained on.
    """
    plan = plan_records(pages, min_revisit_bytes, archive_bytes)
    frames = plan.mapInArrow(archive_writer(level, dict_bytes, dict_sample_bytes, date), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive."""
    if not content:
        return
    words = None
    if content[:4] == DICT_MAGIC:
        words = zstd.ZstdCompressionDict(content[8 : 8 + int.from_bytes(content[4:8], "little")])
    plain = io.BufferedReader(zstd.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(content), read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        fields = {}
        while (line := plain.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = plain.read(int(fields["content-length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield fields, block


def page_of(urn: str | None) -> int | None:
    number = (urn or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def parsed(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return (page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), n_bytes, digest, kind,
            page_of(fields.get("warc-refers-to")), payload if with_payload and kind == "response" else None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record; payloads are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records_of(content.as_py()):
                    if fields["warc-type"] in ("response", "revisit"):
                        rows.append(parsed(fields, block, with_payload))
                        size += len(block)
                    if len(rows) == 5000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, RECORD)

"""WARC archives in Zstandard: one frame per record, the dictionary in front.

An archive begins with a skippable frame that holds its dictionary, trained on a bounded sample
of the archive's own records (none if there are too few). Each record is one frame. Archives are
files below the shared folder, written by Spark's text writer with a separator that is itself an
empty skippable frame, so every file is a valid sequence of frames. The reader takes such
files, of this writer or another, loads the dictionary, decodes frame by frame and checks
versions, headers, lengths and digests.

Payloads that repeat are stored once: the record of the largest page id is the response, the
others are revisits that refer to it and keep its HTTP head.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import broadcastable, known, saved, slices
from tessera.session import scratch_path

#: Magic numbers and fixed lines of the formats (fixed values).
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
SEPARATOR = "P*M\x18\0\0\0\0"  # an empty skippable frame
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 4 << 20  # of records, before compression
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 64, 4 << 10
LEAST_REVISITED = 1000
READ_BYTES = 1 << 16
#: Revisits that are broadcast at most (some 30 MB); beyond, they are joined by a shuffle.
MAX_SENT = 500_000


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit if ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date),
            ("WARC-Target-URI", quote(url or "urn:none", safe="!#$%&'()*+,/:;=?@[]~-._")),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())]
    if refers_to is not None:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", IDENTICAL)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step][:SAMPLES]]
    try:
        dictionary = zstd.train_dictionary(DICTIONARY_BYTES, samples)
    except zstd.ZstdError:  # too few samples, or too alike
        c = zstd.ZstdCompressor(level=3)
        return b"".join(c.compress(r) for r in records)
    c = zstd.ZstdCompressor(level=3, dict_data=dictionary)
    front = struct.pack("<II", DICTIONARY_MAGIC, len(raw := dictionary.as_bytes())) + raw
    return front + b"".join(c.compress(r) for r in records)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame; the leading dictionary is used, other skippable frames are
    passed over. A cut or broken frame is an error."""
    view, at, decompressor = memoryview(data), 0, zstd.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"{len(data) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & SKIPPABLE_MASK == SKIPPABLE_MAGIC:
            if at + 8 + size > len(data):
                raise ValueError(f"skippable frame at {at} is cut")
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(view[8:8 + size])
                if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                    raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
                decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        d, parts, pos = decompressor.decompressobj(), [], at
        while not d.eof and pos < len(data):
            parts.append(d.decompress(view[pos:pos + READ_BYTES]))
            pos = min(pos + READ_BYTES, len(data))
        if not d.eof:
            raise ValueError(f"frame at {at} is cut")
        yield at, b"".join(parts)
        at = pos - len(d.unused_data)


def parse(data: bytes) -> dict:
    """A record's fields, checked; ValueError says what is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no WARC/1.1 head")
    h = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.lower() in h:
            raise ValueError(f"bad header line {line[:80]!r}")
        h[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"no {name}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content length {size} does not match the block")
    out = {"record_type": h["warc-type"], "record_id": h["warc-record-id"], "url": h.get("warc-target-uri"), "refers_to": None}
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = h.get("warc-payload-digest", "")
    if not found or length is None or not digest.startswith("sha1:"):
        raise ValueError("no HTTP head, length or digest")
    out["payload_bytes"], out["payload_digest"] = length, base64.b32decode(digest[5:]).hex()
    if out["record_type"] == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
            raise ValueError("payload does not match its length and digest")
        out["payload"] = payload
    elif out["record_type"] == "revisit":
        if payload or "warc-refers-to" not in h or h.get("warc-profile") != IDENTICAL:
            raise ValueError("bad revisit")
        out["refers_to"], out["payload"] = h["warc-refers-to"], None
    else:
        raise ValueError(f"record type {out['record_type']}")
    return out


def _revisits(pages: DataFrame) -> DataFrame:
    """(id, digest, refers_to) of rows whose payload another row keeps."""
    sums = pages.where(F.octet_length("body") >= LEAST_REVISITED) \
        .select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").alias("size"))
    keep = sums.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")) \
        .where("n > 1 and refers_to is not null").drop("n")
    again = sums.join(keep, ["digest", "size"]).where("page_id is null or page_id != refers_to")
    return saved(again.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "digest", "refers_to").distinct(), "warc-revisits")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of (page_id, url, html) below ``path``, some ``archive_bytes`` to a
    file. Tasks hold one archive's records at a time.

    Null html is an empty payload, a null url ``urn:none``. A row with a null id is written with
    the id ``none`` and can be a revisit, never what others refer to. Repeated rows are written
    each; of those with the largest id all are responses. Further columns are ignored.
    """
    rows = known(pages, page_id="long", url="string", html="binary") \
        .select("page_id", "url", F.coalesce("html", F.lit(b"")).alias("body"))
    again = _revisits(rows)
    keyed = rows.withColumn("id", F.coalesce("page_id", F.lit(-(1 << 63)))).withColumn("digest", F.sha1("body"))
    if broadcastable(again, MAX_SENT):
        again = F.broadcast(again)
    joined = keyed.join(again, ["id", "digest"], "left").select("page_id", "body", "url", "refers_to")

    def run(batches):
        records, size = [], 0
        for s in slices(batches):
            for page_id, body, url, refers_to in zip(*(c.to_pylist() for c in s.columns)):
                records.append(record(page_id, url, body, refers_to, date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary())], ["content"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary())], ["content"])

    # A string column holds any bytes; the text writer writes them as they are.
    joined.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value")) \
        .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """(archive, offset, page_id, record_type, url, payload_bytes, payload_digest, refers_to, problem
    [, payload]) of each record below ``path``. With ``strict`` a bad record or archive stops the job;
    otherwise ``problem`` says what is wrong (the rest of a broken archive is one such row)."""
    names = ["archive", "offset", "page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "problem"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    schema = "archive string, offset long, page_id long, record_type string, url string, payload_bytes long, " \
             "payload_digest string, refers_to long, problem string" + ", payload binary" * payloads
    arrow = pa.schema([*zip(names, types)] + [("payload", pa.binary())] * payloads)

    def read(name: str, data: bytes) -> Iterator[dict]:
        at = 0
        try:
            for at, raw in frames(data):
                try:
                    r = parse(raw)
                    r["page_id"] = _page(r["record_id"])
                    r["refers_to"] = r["refers_to"] and _page(r["refers_to"])
                    yield r | {"archive": name, "offset": at, "problem": None}
                except ValueError as e:
                    if strict:
                        raise
                    yield {"archive": name, "offset": at, "problem": str(e)}
        except (ValueError, zstd.ZstdError) as e:
            if strict:
                raise ValueError(f"{name} at {at}: {e}") from e
            yield {"archive": name, "offset": at, "problem": str(e)}

    def run(batches):
        for s in slices(batches, size=1):
            for name, data in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                part, size = [], 0
                for r in read(name, data):
                    part.append({k: r.get(k) for k in arrow.names})
                    size += len(r.get("payload") or b"") if payloads else 0
                    if size > ARCHIVE_BYTES or len(part) > 5000:
                        yield pa.RecordBatch.from_pylist(part, arrow)
                        part, size = [], 0
                yield pa.RecordBatch.from_pylist(part, arrow)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("archive"), "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives below the shared folder and read them back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to), a row per row of pages; none for an empty table."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame that holds its dictionary; then each record is one frame
of its own, so a reader that knows a record's place needs nothing but the dictionary.  Tasks write
archives under names of their own to a shared folder and report them in a manifest, a Parquet
table; what a lost or repeated task leaves behind is in no manifest and never read.  Both writer
and reader hold one archive's buffered records, or one record, at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsift.llm.common import shared_folder, written
from fleetsift.shipping import ship_by_value

ship_by_value(__name__)

DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which the next archive begins, bytes of a dictionary, payloads it is made from.
ARCHIVE_BYTES, DICTIONARY_BYTES, DICTIONARY_PAYLOADS = 64 << 20, 64 << 10, 200
#: Payloads from this length on are stored once.
LEAST_SHARED = 1000
ID = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str, date: str) -> bytes:
    """One WARC 1.1 record: an HTTP response, or a revisit that keeps only the response's head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A trained dictionary; where the records are too few or too short for one, their own beginnings."""
    samples = [r[:32_768] for r in records[:DICTIONARY_PAYLOADS]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    return trained or b"".join(samples)[:DICTIONARY_BYTES]


def _write_archive(folder: str, records: list[bytes]) -> dict:
    system, at = fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.warc.zst"
    dictionary = dictionary_of(records)
    packer = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    with system.open_output_stream(f"{at}/{name}", compression=None) as out:
        if dictionary:
            packed = zstandard.compress(dictionary)
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        for r in records:
            out.write(packer.compress(r))
    return {"archive": f"{folder}/{name}", "records": len(records)}


def _writer(folder: str, date: str):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            page, url, html, digest, refers, kind = batch.columns
            for i in range(batch.num_rows):
                held.append(record(page[i].as_py(), url[i].as_py(), (html[i].as_py() or "").encode(), digest[i].as_py(), refers[i].as_py(), kind[i].as_py(), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pylist([_write_archive(folder, held)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_write_archive(folder, held)], schema=schema)
    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one record for each row of `pages`; returns the manifest (archive, records).

    Of rows with equal payloads of at least LEAST_SHARED bytes, the one with the largest id is
    stored as a response and the others as revisits of it; shorter payloads are always stored.  A
    null payload is an empty one.  Rows with a null id revisit the largest id, or are stored where
    no row of the group has one; a row that repeats the largest id is stored again.  Other columns
    are ignored; an empty table gives an empty manifest.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                        F.sha1(html.cast("binary")).alias("digest"))
    keys = written(rows.where(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest"), "warc-keys")
    groups = written(keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
                     .where("n > 1 and refers_to is not null").select("digest", "refers_to"), "warc-groups")
    revisits = (keys.join(groups, "digest").where("page_id is null or page_id <> refers_to")
                .select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("key"), "digest", "refers_to").distinct())
    typed = (rows.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63)))).join(revisits, ["key", "digest"], "left")
             .select("page_id", "url", "html", "digest", "refers_to",
                     F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("kind")))
    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    return written(typed.mapInArrow(_writer(folder, date), "archive string, records bigint"), "warc-manifest")


def frames(stream) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, error) for each frame of an archive; a broken frame is the last one."""
    start = stream.read(8)
    dictionary, held = None, start
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", start[4:])[0]
        content, held = stream.read(size), b""
        if len(content) != size:
            yield None, "the dictionary is cut off"
            return
        if content[:4] == struct.pack("<I", ZSTD_FRAME):
            try:
                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            except zstandard.ZstdError as error:
                yield None, f"the dictionary can't be read: {error}"
                return
        dictionary = zstandard.ZstdCompressionDict(content)
    opener = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while True:
        held = held or stream.read(1 << 16)
        if not held:
            return
        while len(held) < 4 and (more := stream.read(1 << 16)):
            held += more
        if len(held) >= 4 and struct.unpack("<I", held[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            while len(held) < 8 and (more := stream.read(1 << 16)):
                held += more
            skip = 8 + struct.unpack("<I", held[4:8].ljust(4, b"\0"))[0]
            while len(held) < skip and (more := stream.read(1 << 16)):
                held += more
            held = held[skip:]
            continue
        frame, parts = opener.decompressobj(), []
        try:
            while not frame.eof:
                if not held and not (held := stream.read(1 << 16)):
                    yield None, "the last frame is cut off"
                    return
                parts.append(frame.decompress(held))
                held = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as error:
            yield None, f"a frame can't be read: {error}"
            return
        yield b"".join(parts), None


def parsed(data: bytes) -> dict:
    """The fields of a record; `error` says what is wrong with it, if anything."""
    out = dict.fromkeys(("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "error"))
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"error": f"a header line without a colon: {line[:80]}"}
        fields[name.strip().lower()] = value.strip()
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]) or missing:
        return out | {"error": f"not a WARC record: {lines[0][:40]}, without {missing}"}
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": f"Content-Length {fields['content-length']} is not that of the block"}
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^Content-Length: *(\d+)", http)
    digest = fields.get("warc-payload-digest", "")
    out |= {"url": fields.get("warc-target-uri"), "record_type": fields["warc-type"]}
    if not mark or not length or not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
        return out | {"error": "no HTTP head, length or SHA-1 digest"}
    out |= {"payload_bytes": int(length[1]), "payload_digest": base64.b32decode(digest[5:]).hex()}
    for name, key in (("page_id", "warc-record-id"), ("refers_to", "warc-refers-to")):
        if (m := re.fullmatch(rf"<{ID}(-?\d+)>", fields.get(key, ""))):
            out[name] = int(m[1])
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
            return out | {"error": "the payload has not the length or digest of the headers"}
        out["payload"] = payload
    elif out["record_type"] != "revisit" or payload or "warc-refers-to" not in fields:
        return out | {"error": f"a {out['record_type']} record that can't be used"}
    return out


SCHEMA = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("error", pa.string())])


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for data, error in frames(stream):
                        row = parsed(data) if error is None else {"error": error}
                        size += row["payload_bytes"] or 0 if error is None else 0
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row | {"archive": archive})
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
    return run


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives (archive: path), one row each, in the columns of SCHEMA.

    Frames are decoded one at a time with the dictionary of the leading skippable frame, if there is
    one.  A record with wrong headers, length or digest, and what follows a broken frame, comes as a
    row with `error`; the others are not touched by it.  Revisits have no payload of their own: its
    length and digest are those of the record they refer to.
    """
    columns = "archive string, page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, error string"
    # As many tasks as archives, within reason: paths are so short that they would all be put into one.
    tasks = max(1, min(10_000, archives.count()))
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(_reader(with_payload), columns)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes the pages to a new folder and reads them back; fails if a record is not valid."""
    manifest = write_archives(pages, shared_folder(spark, "warc"))
    rows = read_archives(manifest, with_payload=False)
    checked = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "error")).cast("bigint"))
    return rows.select(checked.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")

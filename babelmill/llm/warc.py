"""Operator 3, WARC: a Zstandard archive writer and reader.

An archive is one .warc.zst file: a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame a record.
`write_archives` turns rows into archives of bounded size, `write_files` writes each to a file of a folder that all
executors reach, and `read_files` reads those back that a finished task has written (a lost task's files are passed
over). `read_archives` takes any DataFrame with a binary `content` column, so spark.read.format("binaryFile") too. The
reader loads the dictionary from the leading frame, decodes one frame after another in time linear in the archive, and
validates version, headers, Content-Length, block and payload digests; a damaged record is a row with its `error`, and a
frame that can't be decoded, or that holds more than RECORD_BYTES, ends its archive with such a row.

Defined cases: null html is an empty payload; a null page_id or url leaves its header out and is read back as null;
characters that a header can't hold are percent-encoded, and decoded when read; of rows equal in payload (1000 bytes
or more) those with the largest page_id are responses, so a repeated row is a response like its copy, and all are if
none has a page_id; a very long page is one record of one frame, up to RECORD_BYTES; an empty table gives no archives
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelmill.llm.common import shared_dir, stored, table

DICT_MAGIC, FRAME_MAGIC, RAW_DICT = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
#: Uncompressed bytes and records of one archive, and the dictionary trained on its payloads.
ARCHIVE_BYTES, ARCHIVE_RECORDS, DICT_BYTES, DICT_SAMPLE = 32 << 20, 1 << 16, 16 << 10, 1 << 20
#: What one record may hold when read, and bytes of an archive given to the decoder at first.
RECORD_BYTES, SLICE = 1 << 30, 1 << 13
REVISIT_LEAST = 1000
#: Digests that a broadcast may hold (40 bytes each); beyond that the join is an ordinary one.
BROADCAST_DIGESTS = 1 << 19
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=-._~')}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_bytes(records: list[bytes]) -> bytes:
    """A dictionary frame, if a dictionary can be trained, and one frame a record."""
    sample, room = [], DICT_SAMPLE
    for r in records:
        if (room := room - len(r)) < 0:
            break
        sample.append(r)
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, sample) if len(sample) >= 16 else None
    except zstandard.ZstdError:  # too few or too uniform samples: an archive without a dictionary is valid, too
        trained = None
    content = zstandard.ZstdCompressor().compress(trained.as_bytes()) if trained else b""
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True)
    lead = struct.pack("<II", DICT_MAGIC, len(content)) + content if trained else b""
    return lead + b"".join(packer.compress(r) for r in records)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    size = 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive_bytes(records)], pa.binary()), pa.array([len(records)], pa.int64())], ["content", "n_records"])

    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            for row in part.to_pylist():
                payload = (row["html"] or "").encode()
                records.append(record_bytes(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["revisit"]))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES or len(records) >= ARCHIVE_RECORDS:
                    yield done()
                    records, size = [], 0
    if records:
        yield done()


def write_archives(pages: DataFrame) -> DataFrame:
    """content, n_records: archives of the pages (page_id, url, html), duplicates of long payloads as revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("_bytes"))
    # Pre-aggregated before the shuffle; only digests met more than once are joined back.
    groups = (
        p.where(F.col("_bytes") >= REVISIT_LEAST).groupBy("digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1 and _first is not null").select(F.col("digest").alias("_digest"), "_first")
    )
    groups = stored(groups, "warc-repeated")
    if groups.count() <= BROADCAST_DIGESTS:
        groups = F.broadcast(groups)
    p = p.join(groups, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    p = p.select("page_id", "url", "html", "digest", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))
    return p.mapInArrow(_write, "content binary, n_records long")


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """name, n_records: each archive written as {name} in the folder, a URI that all executors reach.

    A name is the digest of the archive, so a task that runs again writes the same files, or leaves ones that are not named.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        files.create_dir(path)
        for batch in batches:
            names = []
            for content in batch.column("content"):
                held = content.as_buffer()
                names.append(f"{hashlib.sha1(held).hexdigest()}.warc.zst")
                begun = f"{path}/.{names[-1]}.{uuid.uuid4().hex}"
                with files.open_output_stream(begun) as out:
                    out.write(held)
                files.move(begun, f"{path}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column("n_records")], ["name", "n_records"])

    return stored(archives.select("content", "n_records").mapInArrow(write, "name string, n_records long"), "warc-names")


def read_files(folder: str, names: DataFrame) -> DataFrame:
    """path, content of the named files of a folder."""
    spark = names.sparkSession
    if not names.head(1):
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.join(names.select("name").distinct(), "name", "left_semi").select("path", "content")


def frames(content: bytes, most: int = RECORD_BYTES) -> Iterator[tuple[bytes, str | None]]:
    """Each record's bytes, or what is wrong with its frame."""
    view, at = memoryview(content), 0
    unpack = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 <= len(view) and 0x184D2A50 <= int.from_bytes(view[at : at + 4], "little") <= 0x184D2A5F:
            magic, size = struct.unpack_from("<II", view, at)
            if at == 0 and magic == DICT_MAGIC:
                held = bytes(view[8 : 8 + size])
                if len(held) != size:
                    yield b"", "the dictionary frame is cut off"
                    return
                try:
                    if held.startswith(FRAME_MAGIC):
                        held = zstandard.ZstdDecompressor().decompress(held, max_output_size=1 << 26)
                except zstandard.ZstdError as e:
                    yield b"", f"the dictionary can't be decoded: {e}"
                    return
                if not held.startswith(RAW_DICT):
                    yield b"", "the leading frame holds no dictionary"
                    return
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
            continue
        one, parts, total, step = unpack.decompressobj(), [], 0, SLICE
        try:
            declared = zstandard.frame_content_size(bytes(view[at : at + 18]))
            while total <= most >= declared and not one.eof and at < len(view):
                piece = view[at : at + step]
                parts.append(one.decompress(piece))
                total += len(parts[-1])
                at += len(piece)
                step = min(2 * step, 1 << 20)
        except zstandard.ZstdError as e:
            yield b"", f"a frame can't be decoded: {e}"
            return
        if total > most or declared > most:
            yield b"", "a record is too long"
            return
        if not one.eof:
            yield b"", "the last frame is cut off"
            return
        at -= len(one.unused_data)
        yield b"".join(parts), None


def parse_record(record: bytes) -> dict:
    """The fields of one record; `error` says what its validation found."""
    out: dict = {"error": None}
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC header"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return out | {"error": f"not a header line: {line[:60]}"}
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length", "warc-date"):
        if name not in fields:
            return out | {"error": f"no {name}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": "Content-Length is not the length of the block"}
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        return out | {"error": "the block digest differs"}
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not sep or not length.isdigit():
        return out | {"error": "no HTTP header"}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    ident = lambda x: int(x[10:-1]) if x.startswith("<urn:page:") and x[10:-1].lstrip("-").isdigit() else None
    out |= {
        "page_id": ident(fields["warc-record-id"]), "record_type": fields["warc-type"], "payload_bytes": int(length), "payload_digest": digest,
        "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "refers_to": ident(fields.get("warc-refers-to", "")),
    }
    if fields["warc-type"] == "response":
        if len(payload) != int(length):
            return out | {"error": "the payload's length differs"}
        if hashlib.sha1(payload).hexdigest() != digest:
            return out | {"error": "the payload digest differs"}
        out["payload"] = payload
    elif out["refers_to"] is None:
        out["error"] = "a revisit without WARC-Refers-To"
    return out


RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string()),
])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record of every archive in `content`; payloads=False leaves the payload out after its validation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                for record, error in frames(content.as_py() or b""):
                    row = {"error": error} if error else parse_record(record)
                    rows.append(row if payloads else {k: v for k, v in row.items() if k != "payload"})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    return archives.select("content").mapInArrow(
        read,
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    names = write_files(write_archives(table(spark, sf_dir, "pages")), folder)
    return read_archives(read_files(folder, names), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error"
    )

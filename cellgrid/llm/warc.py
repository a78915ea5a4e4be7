"""WARC archives compressed record by record with a dictionary of their own.

An archive begins with a skippable Zstandard frame that holds a dictionary trained on the
archive's own records; each record follows as a frame of its own, so that single records
can be read at their offsets and small ones still compress well.  Equal payloads are
stored once: the record of the largest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import arrow_map, row_key, write_table
from cellgrid.llm.words import slices
from cellgrid.session import work_dir

ARCHIVE_BYTES = 8 << 20  # records of about so many bytes go to one archive; they are held in memory while it is written
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
DICTIONARY_FRAME = 0x184D2A5D  # fixed value: magic number of the skippable frame that holds a dictionary
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture date
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _file_system(uri: str):
    """(file system, path in it) of a shared folder, for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, size: int, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header of its response but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes], most: int = DICTIONARY_BYTES):
    """Dictionary from records spread over the archive; with too few to train on, their last bytes."""
    import zstandard as zstd

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = records[::step]
    try:
        return zstd.train_dictionary(min(most, max(256, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except (zstd.ZstdError, ValueError):
        return zstd.ZstdCompressionDict(b"".join(samples)[-most:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 6) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive's bytes, and (offset, length) of each record's frame."""
    import zstandard as zstd

    words = train(records)
    raw = words.as_bytes()
    out = io.BytesIO()
    out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    compressor = zstd.ZstdCompressor(level=level, dict_data=words, write_checksum=True)
    places = []
    for item in records:
        frame = compressor.compress(item)
        places.append((out.tell(), len(frame)))
        out.write(frame)
    return out.getvalue(), places


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a binary stream."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    words = zstd.ZstdCompressionDict(source.read(size))
    lines = io.BufferedReader(zstd.ZstdDecompressor(dict_data=words).stream_reader(source, read_across_frames=True), 1 << 16)
    while first := lines.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError("a record has no version line")
        head = {}
        while (line := lines.readline().rstrip(b"\r\n")) != b"":
            key, _, value = line.decode().partition(": ")
            head[key] = value
        block = lines.read(int(head["Content-Length"]))
        lines.read(4)
        yield head, block


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); return (path, page_id, offset, length) of each.

    A null html is an empty payload, a null url is left out.  Rows that repeat are written
    as often as they occur.  Rows without a page_id cannot be revisited, but revisit an
    equal payload that has one.  Files of attempts that failed are not among the paths.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def digests(batch: pa.RecordBatch):
        for piece in slices(batch, "html"):
            found = [((v := (x.as_py() or "").encode()), digest(v)) for x in piece.column("html")]
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in ("__id", "__th", "page_id")), pa.array([d for _, d in found], pa.string()), pa.array([len(v) for v, _ in found], pa.int64())], ["__id", "__th", "page_id", "digest", "size"])

    found = write_table(arrow_map(rows.select(*row_key("page_id", "html"), "page_id", "html"), digests, "__id long, __th int, page_id long, digest string, size long"), "digests")
    several = write_table(found.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null").select("digest", "response"), "responses")
    revisits = write_table(found.join(several, "digest").filter(~F.col("page_id").eqNullSafe(F.col("response"))).select("__id", "__th", F.col("response").alias("refers_to")).distinct(), "revisits")
    ready = rows.select(*row_key("page_id", "html"), "*").join(revisits, ["__id", "__th"], "left").select("page_id", "url", "html", "refers_to")
    label = uuid.uuid4().hex

    def write(batches):
        context = TaskContext.get()
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        held: list[tuple[int | None, bytes]] = []
        size = number = 0

        def flush():
            nonlocal size, number
            name = f"{label}-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
            data, places = archive([r for _, r in held])
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            made = pa.RecordBatch.from_arrays(
                [pa.array([f"{folder.rstrip('/')}/{name}"] * len(held)), pa.array([i for i, _ in held], pa.int64()), pa.array([a for a, _ in places], pa.int64()), pa.array([b for _, b in places], pa.int64())],
                ["path", "page_id", "offset", "length"],
            )
            held.clear()
            size, number = 0, number + 1
            return made

        for batch in batches:
            for piece in slices(batch, "html"):
                for page_id, url, html, refers_to in zip(*(piece.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = (html or "").encode()
                    held.append((page_id, record(page_id, url, payload, digest(payload), len(payload), refers_to, date)))
                    size += len(held[-1][1])
                    if size >= archive_bytes:
                        yield flush()
        if held:
            yield flush()

    return write_table(ready.mapInArrow(write, "path string, page_id long, offset long, length long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for every record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Payloads of responses are checked against their digests.  Revisits have a null payload.
    """

    def page(uri: str | None) -> int | None:
        name = (uri or "").strip("<>").rpartition(":")[2]
        return None if name in ("", "none") else int(name)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                out, size = [], 0
                with system.open_input_stream(name) as source:
                    for head, block in read_archive(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        response = head["WARC-Type"] == "response"
                        named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and digest(payload) != named:
                            raise ValueError(f"{path}: {head['WARC-Record-ID']} does not have the payload of its digest")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        out.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), length, named, head["WARC-Type"], page(head.get("WARC-Refers-To")), payload if response else None))
                        size += len(block)
                        if size > 4 << 20:
                            yield rows(out)
                            out, size = [], 0
                if out:
                    yield rows(out)

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
    paths = manifest.select("path").distinct()
    apart = paths.repartition(max(1, paths.count()))  # a few bytes each, so their number and not their size must set the tasks
    return apart.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    return read_archives(write_archives(pages, folder or f"{work_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"))

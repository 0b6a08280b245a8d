"""Web archives: whole-file gzip streams written from pages, normalised to one member per record with an offset index, and read back."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from assayer.llm.stored import stored
from assayer.session import scratch_path

LEVEL, CHUNK = 5, 1 << 20
_DATE = "2000-01-01T00:00:00Z"
_GZIP = 16 + zlib.MAX_WBITS


def _open(path: str, mode: str):
    """Stream to or from a path of any file system that Arrow knows by its scheme; a bare path is local."""
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    if mode == "write":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_file(inner) if mode == "seek" else system.open_input_stream(inner, compression=None)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_NO_PAGE = "!"  # quoting never leaves this mark in an id


def page_name(page_id) -> str:
    return f"<urn:page:{_NO_PAGE if page_id is None else quote(str(page_id), safe='')}>"


def page_of(name: str) -> str | None:
    key = name[len("<urn:page:"):-1]
    return None if key == _NO_PAGE else unquote(key)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, size: int | None = None) -> bytes:
    """One response record with its payload, or a revisit record without it where ``refers_to`` names the response; ``size`` is then the payload's."""
    name = page_name
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    block = head.encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return headers, rest[:int(headers["content-length"])]


def inflated(stream) -> Iterator[bytes]:
    """Contents of a gzip stream in chunks, whether it is one member or many."""
    machine = zlib.decompressobj(_GZIP)
    while data := stream.read(CHUNK):
        while data:
            if out := machine.decompress(data, 4 * CHUNK):
                yield out
            data = machine.unconsumed_tail or machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(_GZIP)
    if out := machine.flush():
        yield out


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; holds one record and a chunk at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = next(int(line[15:]) for line in bytes(held[:end]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
            total = end + 4 + size + 4
            if len(held) < total:
                break
            yield bytes(held[:total])
            del held[:total]
    if held.strip():
        raise ValueError("truncated archive")


def write_archives(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Writes a record per page into whole-file gzip streams below ``folder``, one file a task; returns ``path, n_records``.

    Of pages with equal payloads the one with the largest ``page_id`` is stored, the others refer to it. Which pages refer to another is
    settled on ids and digests alone, then joined to the pages by both, so pages of one payload never meet and revisits carry none. Every
    attempt of a task writes a file of its own name, and only the files of successful attempts are listed.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    held = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("hash"))
    keyed = stored(held.select("page_id", "hash"), "page-digests")
    repeated = keyed.groupBy("hash").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null").drop("n")
    other = keyed.join(repeated, "hash").where(~F.col("page_id").eqNullSafe(F.col("response"))).distinct()
    other = stored(other.select(F.col("page_id").alias("_page"), F.col("hash").alias("_hash"), "response"), "revisits")
    typed = held.join(other, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("hash") == F.col("_hash")), "left")
    typed = typed.select("page_id", "url", F.when(F.col("response").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("size"), "hash", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, count, out, machine = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(level, zlib.DEFLATED, _GZIP)
        for batch in batches:
            for page_id, url, payload, size, digest, response in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or _open(path, "write")
                out.write(machine.compress(record(page_id, url, (payload or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), response, size)))
                count += 1
        if out is not None:
            out.write(machine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "n_records": pa.array([count], pa.int64())})

    listed = scratch_path(pages.sparkSession, "archives")
    typed.mapInArrow(write, "path string, n_records bigint").write.parquet(listed)
    return pages.sparkSession.read.parquet(listed)


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites whole-file gzip archives below ``folder`` with every record as its own member, and a sidecar offset index beside each.

    ``archives`` holds ``path``. Each file is inflated once, as a stream; a task holds one record at a time. Returns the index: ``path, offset,
    length, record_id``, also written as JSON lines to ``<path>.index``. Files that hold several members already pass through as well; a cut-off
    archive fails with an error instead of losing records.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                path, at, rows = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, []
                with _open(source, "read") as stream, _open(path, "write") as out:
                    for raw in records(inflated(stream)):
                        machine = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = machine.compress(raw) + machine.flush()
                        out.write(member)
                        rows.append((at, len(member), parse(raw)[0]["warc-record-id"]))
                        at += len(member)
                with _open(f"{path}.index", "write") as side:
                    for row in rows:
                        side.write((json.dumps(dict(zip(("offset", "length", "record_id"), row))) + "\n").encode())
                if rows:
                    offset, length, name = zip(*rows)
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(rows)), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64()), "record_id": pa.array(name)})

    spark = archives.sparkSession
    listed = scratch_path(spark, "index")
    tasks = max(1, archives.count())
    archives.select("path").repartition(tasks, "path").mapInArrow(run, "path string, offset bigint, length bigint, record_id string").write.parquet(listed)
    return spark.read.parquet(listed)


def read_records(index: DataFrame, kind: str = "bigint") -> DataFrame:
    """Records of normalised archives by their offsets: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Every record is one ranged read and one inflated member. A response's size and digest are those of the payload read, checked against
    its header; a revisit takes the size from the response it refers to.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, stream = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != source:
                    source, stream = path, _open(path, "seek")
                stream.seek(offset)
                headers, block = parse(zlib.decompress(stream.read(length), _GZIP))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size = None
                if headers["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = len(payload)
                    if payload_digest(payload) != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                rows.append((page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None))
            yield pa.RecordBatch.from_pylist([dict(zip(("page_id", "size", "payload_digest", "record_type", "refers_to"), r)) for r in rows],
                                             schema=pa.schema([("page_id", pa.string()), ("size", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]))

    plain = index.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset").mapInArrow(run, "page_id string, size bigint, payload_digest string, record_type string, refers_to string")
    rows = stored(plain, "records")
    # Sizes of the responses that revisits refer to; only revisits look for one.
    responses, revisits = rows.where("record_type = 'response'"), rows.where("record_type <> 'response'")
    originals = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("size").alias("its_size"))
    sized = revisits.join(originals, ["refers_to", "payload_digest"], "left").select("page_id", F.col("its_size").alias("size"), "payload_digest", "record_type", "refers_to")
    both = responses.select(*sized.columns).unionByName(sized)
    return both.select(F.col("page_id").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def archive_round_trip(pages: DataFrame, folder: str | None = None, level: int = LEVEL) -> DataFrame:
    """Pages written as whole-file gzip archives, normalised, and read back by their offsets.

    ``pages`` holds ``page_id, url, html``; further columns are ignored. The reference project keeps no web pages, so the operator is general.
    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per page. The files stay below ``folder`` (by default below the
    cluster's shared folder): ``raw/`` holds the streams, ``members/`` the archives of single members and their ``.index`` files.

    A null ``html`` is an empty payload, and empty payloads are deduplicated like others; a null ``url`` leaves the target out; control
    characters of a ``url`` are escaped; a null ``page_id`` comes back as null; rows that repeat a ``page_id`` and payload are each answered; an
    empty table gives an empty result.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = normalise(write_archives(pages, f"{folder}/raw", level), f"{folder}/members", level)
    return read_records(index, pages.schema["page_id"].dataType.simpleString())

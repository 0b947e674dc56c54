"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writers roll their files at a size and train each file's dictionary on its first
records.  A record whose payload another page holds too is a revisit of the page
of the largest id with that payload; its block has the HTTP header alone.  The
manifest (one row a file) is materialised before anything is read, so files of
lost attempts are never seen.  Readers decode frame by frame in bounded memory,
and check the magic of the dictionary's frame, version line, header syntax,
lengths, closing line breaks and digests; an archive that fails raises.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.token_store import task_a_file
from corpusloom.llm.workspace import arrow_map, cut, file_system, fresh_dir, slices

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcSpec:
    """least_bytes: smaller payloads are always responses; file_bytes: raw bytes at which a file is closed; sample_bytes: of a file's first records that train its dictionary."""

    least_bytes: int = 0
    file_bytes: int = 256 << 20
    sample_bytes: int = 1 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 3
    date: str = "2026-01-01T00:00:00Z"
    broadcast_rows: int = 500_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, own)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._{}|^`<>\"\\"))
    if page_id is not None:
        lines.append(f"WARC-X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, own)}", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{own}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str | None
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes


def parse_record(data: bytes) -> Record:
    """Check one decoded frame and take it apart; ValueError says what is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("record header does not end")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a WARC/1.1 record: {version[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    n = fields["content-length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"content-length {n} but {len(rest) - 4} bytes follow")
    block = rest[:-4]
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not gap or not http.startswith(b"HTTP/1.1 ") or length is None:
        raise ValueError("bad HTTP header")
    kind, claimed = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if len(payload) != length or digest(payload) != claimed:
            raise ValueError("payload length or digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"bad record of type {kind}")
    number = lambda name: int(fields[name]) if name in fields else None
    return Record(kind, number("warc-x-page-id"), fields.get("warc-target-uri"), number("warc-x-refers-to-page-id"), length, claimed, payload)


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of these records; raw content where they are too few to train on; None where they are next to nothing."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[:size]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def read_dictionary(source) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of an archive opened at its start; the source then stands at the first record, or at 0 without one."""
    head = source.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        n = struct.unpack("<I", head[4:])[0]
        data = source.read(n)
        if len(data) != n:
            raise ValueError("the dictionary's frame is cut off")
        if data[:4] == ZSTD_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        return zstandard.ZstdCompressionDict(data)
    if head and head[:4] != ZSTD_MAGIC:
        raise ValueError("neither a dictionary nor a record stands at the start")
    source.seek(0)
    return None


def read_records(source, chunk: int = 1 << 20) -> Iterator[Record]:
    """Records of an archive, one frame each, whatever its size."""
    found = read_dictionary(source)
    context = zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()
    held = b""
    while held or (held := source.read(chunk)):
        frame, out = context.decompressobj(), []
        while True:
            out.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = source.read(chunk)
            if not held:
                raise ValueError("the last frame is cut off")
        yield parse_record(b"".join(out))


def write_archives(pages: DataFrame, out: str | None = None, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Write pages(page_id, url, html, ...) and return the manifest (path, n_records, n_bytes).

    A null html is an empty payload, a null url leaves out the target, a null
    page_id is written without one and counts as the smallest.  Of equal
    payloads the largest page_id is the response (each of its rows, if it is
    repeated); the others revisit it.  Other columns are ignored; no rows, no files.
    """
    spark = pages.sparkSession
    out = out or fresh_dir(spark, "warc")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = base.withColumn("key", F.sha1("payload"))
    heads = cut(keyed.filter(F.length("payload") >= spec.least_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("head")).filter("n > 1").select("key", "head"))
    if heads.count() <= spec.broadcast_rows:
        heads = F.broadcast(heads)
    ready = keyed.join(heads, "key", "left").select("page_id", "url", "payload", F.when((F.length("payload") >= spec.least_bytes) & ~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, name, sink, context, size, n, first = [], "", None, None, 0, 0, []

        def begin() -> None:
            nonlocal name, sink, context, size, n, first
            name = f"{out}/part-{uuid.uuid4().hex}.warc.zst"
            fs, path = file_system(name)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            sink, size, n = fs.open_output_stream(path, compression=None), 0, 0
            found = train(first, spec.dictionary_bytes)
            context = zstandard.ZstdCompressor(level=spec.level, dict_data=found) if found else zstandard.ZstdCompressor(level=spec.level)
            if found:
                sink.write(dictionary_frame(found.as_bytes()))
            held, first = first, []
            for record in held:
                put(record)

        def put(record: bytes) -> None:
            nonlocal size, n
            sink.write(context.compress(record))
            size, n = size + len(record), n + 1

        def end() -> None:
            nonlocal sink
            sink.close()
            done.append((name, n, size))
            sink = None

        sampled = 0
        for batch in slices(batches, 64):
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                record = build_record(page_id, url, payload, refers_to, spec.date)
                if sink is not None:
                    put(record)
                    if size >= spec.file_bytes:
                        end()
                        sampled = 0
                else:
                    first.append(record)
                    sampled += len(record)
                    if sampled >= spec.sample_bytes:
                        begin()
        if first:
            begin()
        if sink is not None:
            end()
        if done:
            names, ns, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"path": list(names), "n_records": pa.array(ns, pa.int64()), "n_bytes": pa.array(sizes, pa.int64())})

    return cut(arrow_map(ready, run, "path string, n_records long, n_bytes long"))


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row a record: (page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]).

    A revisit's bytes and digest are those of the full payload; its own payload
    is empty.  The number of records must be the manifest's.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, rows = 0, []
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    try:
                        for r in read_records(source):
                            n += 1
                            rows.append((r.page_id, r.url, r.kind, r.refers_to, r.payload_bytes, r.payload_digest) + ((r.payload,) if with_payload else ()))
                            if len(rows) >= 256:
                                yield batch_of(rows)
                                rows = []
                    except (ValueError, zstandard.ZstdError) as error:
                        raise ValueError(f"{path}, record {n + 1}: {error}") from error
                if n != expected:
                    raise ValueError(f"{path}: {n} records of {expected}")
                if rows:
                    yield batch_of(rows)

    return arrow_map(task_a_file(manifest.select("path", "n_records")), run, schema)

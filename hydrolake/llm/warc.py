"""WARC archives compressed with Zstandard, one frame for each record, behind a dictionary frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record
is one frame compressed with it. Archives are rows (path, content), as Spark's binaryFile source
gives them, so `read_archives` also reads files of other writers. The writer keeps the archives of a
task within `ARCHIVE_BYTES` and Spark writes them to the shared folder.

Records whose payloads are equal and of `REVISIT_BYTES` or more become revisits of the one with the
largest page_id. A revisit has the payload's length and digest in its headers and no payload.

Cases: a null html is an empty payload; a null url becomes a urn; rows that repeat the largest
page_id of a payload are all responses; a row without page_id is a revisit if its payload has a page
with one, else a response; an empty table gives no archives; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake.llm.common import spread_join

# Fixed values of the formats.
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"
REVISIT_BYTES, ARCHIVE_BYTES = 1000, 4 << 20
#: The sample that a dictionary is trained on, and its size.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 200, 1 << 16, 32 << 10
FEED = 32 << 10


class BadRecord(ValueError):
    """An archive or record that breaks the format."""


def plan_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to); refers_to is null for responses.

    Only payloads that can be revisits are shuffled, those of one digest to several tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("size"))
    large = rows.filter(F.col("size") >= REVISIT_BYTES)
    again = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1").select("payload_digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = spread_join(large, again, "payload_digest", "page_id", "left").select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))
    small = rows.filter(F.col("size") < REVISIT_BYTES).select("page_id", "url", "html", "payload_digest", F.lit(None).cast(pages.schema["page_id"].dataType).alias("refers_to"))
    return told.unionByName(small)


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record; only rows that repeat id and payload share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_archives(planned: DataFrame, trained: bytes) -> DataFrame:
    """Archives (path, content) of the planned pages."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True)
        lead = struct.pack("<II", DICT_MAGIC, len(trained)) + trained
        frames, size, number = [lead], len(lead), 0

        def archive():
            path = f"pages-{TaskContext.get().partitionId():06d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(frames)], pa.binary())], ["path", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for r in batch.slice(at, 100).to_pylist():
                    frames.append(packer.compress(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["payload_digest"], r["refers_to"])))
                    size += len(frames[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive()
                        frames, size, number = [lead], len(lead), number + 1
        if len(frames) > 1:
            yield archive()

    return planned.mapInArrow(run, "path string, content binary")


def frames(content: bytes):
    """The decoded frames of an archive, with the dictionary of its leading skippable frame."""
    at, known = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", content, 4)[0]
        held = content[8:at]
        if len(held) != at - 8:
            raise BadRecord("the dictionary frame is cut short")
        if held[:4] == ZSTD_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        known = zstandard.ZstdCompressionDict(held) if held else None
    while at < len(content):
        if content[at : at + 4] != ZSTD_MAGIC:
            raise BadRecord(f"no frame at byte {at}")
        one, parts = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompressobj(), []
        try:
            while not one.eof:
                part = content[at : at + FEED]
                if not part:
                    raise BadRecord("the last frame is cut short")
                parts.append(one.decompress(part))
                at += len(part) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise BadRecord(f"frame before byte {at}: {e}") from None
        yield b"".join(parts)


def _fields(head: bytes, first: str) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not re.fullmatch(first, lines[0]):
        raise BadRecord(f"unknown first line {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"bad header line {line[:40]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(raw: bytes) -> dict:
    """A record's validated headers and payload."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("headers don't end")
    fields = _fields(head, r"WARC/1\.[01]")
    if missing := [n for n in NEEDED if n not in fields]:
        raise BadRecord(f"headers miss {missing}")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("the block's length differs from its header")
    kind, block = fields["warc-type"], rest[:-4]
    out = {"record_type": kind, "uri": fields.get("warc-target-uri"), "page_id": fields.get("warc-page-id"), "refers_to": fields.get("warc-refers-to-page-id"), "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": len(block), "payload_digest": hashlib.sha1(block).hexdigest()}
    head, gap, payload = block.partition(b"\r\n\r\n")
    http = _fields(head, r"HTTP/1\.[01] \d{3}.*")
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields or not stated:
            raise BadRecord("a revisit needs a digest and what it refers to, and has no payload")
        return out | {"payload_bytes": int(http["content-length"]), "payload_digest": stated}
    digest = hashlib.sha1(payload).hexdigest()
    if "content-length" in http and int(http["content-length"]) != len(payload):
        raise BadRecord("the payload's length differs from its header")
    if len(stated) == 40 and stated.lower() != digest:
        raise BadRecord("the payload's digest differs from its header")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


RECORDS = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path, content); without `payloads` that column is null."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                out, size = [], 0
                try:
                    for raw in frames(content):
                        r = parse(raw)
                        for c in ("page_id", "refers_to"):
                            r[c] = None if r[c] is None else int(r[c])
                        if not payloads:
                            r["payload"] = None
                        out.append(r)
                        size += len(r["payload"] or b"") + 200
                        if size > ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pylist(out, RECORDS)
                            out, size = [], 0
                except BadRecord as e:
                    raise BadRecord(f"{path}: {e}") from None
                if out:
                    yield pa.RecordBatch.from_pylist(out, RECORDS)

    return archives.select("path", "content").mapInArrow(run, from_arrow_schema(RECORDS))


def sample(pages: DataFrame) -> list[bytes]:
    """Records of the beginnings of `SAMPLE_PAGES` pages, to train a dictionary on; they alone reach the driver."""
    head = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS)
    rows = pages.select("page_id", "url", head.alias("head"), F.sha1(F.encode(head, "UTF-8")).alias("d")).limit(SAMPLE_PAGES).collect()
    return [record(r["page_id"], r["url"], r["head"].encode("utf-8", "surrogatepass"), r["d"], None) for r in rows]

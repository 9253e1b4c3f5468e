"""WARC archives, compressed record by record with a Zstandard dictionary that leads each file."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Skippable frame that holds the file's dictionary.
DICT_MAGIC = b"\x5d\x2a\x4d\x18"
#: An empty skippable frame, and valid UTF-8: it stands between the frames where a text writer wants its line ends.
BETWEEN = "P*M\x18\x00\x00\x00\x00"
#: Payloads below this are always stored in full.
MIN_REVISIT = 100
#: Bytes of records from which a file's dictionary is built, and the dictionary's size.
SAMPLE_BYTES, DICT_BYTES = 4 << 20, 64 << 10


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    clean = "".join(c for c in url or "" if c not in "\r\n")
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}",
             f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record; raises ValueError if it isn't whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(headers["content-length"])
    if first != "WARC/1.1" or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a broken WARC record: {headers.get('warc-record-id')}")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def build_dictionary(samples: list[bytes]):
    """A trained dictionary, or the first samples themselves where there are too few to train on; None for none."""
    import zstandard

    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s[: 1 << 17] for s in samples])
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(s[:4096] for s in samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    """The dictionary's frame, then one frame per record. Holds SAMPLE_BYTES of records at most before the first."""
    import zstandard

    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    trained = build_dictionary(held)
    blob = trained.as_bytes()
    yield DICT_MAGIC + struct.pack("<I", len(blob)) + blob
    press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True).compress
    yield from map(press, held)
    del held
    yield from map(press, records)


def unframe(blob: bytes) -> Iterator[bytes]:
    """The records of one archive file, by its frames."""
    import zstandard

    at, undo = 0, None
    while at < len(blob):
        magic = blob[at : at + 4]
        if magic[1:] == b"\x2a\x4d\x18" and 0x50 <= magic[0] <= 0x5F:
            size = struct.unpack("<I", blob[at + 4 : at + 8])[0]
            if magic == DICT_MAGIC:
                body = blob[at + 8 : at + 8 + size]
                kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                undo = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
            at += 8 + size
            continue
        if undo is None:
            raise ValueError("an archive without its leading dictionary")
        one = undo.decompressobj()
        out = one.decompress(memoryview(blob)[at:])
        yield out
        at = len(blob) - len(one.unused_data)


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", files: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record per row of ``pages`` to archive files below ``path``, through Spark's own writer and committer.

    Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest id is a response and the
    others revisit it; smaller payloads are all responses. Null html is an empty payload, a null url an empty one. Rows
    that tie on the smallest id are all responses; of payloads without any id all are. Every task writes one file: its
    dictionary frame from its own records, then each record compressed by itself, so a record can be read from its
    offset and the dictionary alone. A file is a plain .warc.zst stream (empty skippable frames stand between records).
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1").select("digest", "first"))
    linked = rows.join(materialise(firsts, "responses"), "digest", "left")
    if files:
        linked = linked.repartition(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i, url, body, digest, first in zip(*(batch.column(k) for k in range(5))):
                    i, first, body = i.as_py(), first.as_py(), body.as_py()
                    revisit = first is not None and i != first
                    yield record("revisit" if revisit else "response", i, url.as_py(), body, digest.as_py(), first if revisit else None, date)

        held, size = [], 0
        for f in frames(records()):
            held.append(f)
            size += len(f)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    out = linked.select("id", "url", "payload", "digest", "first").mapInArrow(run, "frame binary")
    out.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).text(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The records below ``path``: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.

    Digests of responses are computed again from what was read and must agree with their headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x in (None, "<urn:x-page:>") else x[len("<urn:x-page:") : -1]
        for batch in batches:
            for blob in batch.column(0):
                held, size = [], 0
                for raw in unframe(blob.as_py()):
                    h, body = parse(raw)
                    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload of {h['warc-record-id']} doesn't have its digest")
                    held.append((number(h["warc-record-id"]), h["warc-target-uri"], kind, body if kind == "response" else None, int(h["warc-payload-length"]), digest, number(h.get("warc-refers-to"))))
                    size += len(body)
                    if size > 8 << 20:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def pack(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})

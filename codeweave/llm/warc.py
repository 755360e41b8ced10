"""Zstandard WARC archives with a dictionary: writer and validating reader.

Layout of an archive: one skippable frame (magic 0x184D2A5D) with the dictionary, then
one Zstandard frame per WARC record, so a record can be decoded alone.

Writing: payloads that occur more than once are found on (digest, page id) rows, aggregated
map-side, so a payload that a third of all pages share is one row; the pages then meet the
duplicate digests in a join that adaptive execution splits. Each task rolls its records into
archives of at most about ``ARCHIVE_BYTES`` and trains each archive's dictionary on the first
``SAMPLE_RECORDS`` records of it (a documented bound; the dictionary only changes the size). Archives
are written by Spark itself, one to a file, into any file system it can write to: its text writer
puts the bytes out as they are, and as line end a skippable frame without content, which every Zstandard reader
passes over. Its commit of tasks and of the job keeps the files of lost or repeated tasks out of the folder.

Reading: Spark lists and reads the files; an archive, bounded by its size, is split at frame borders
by walking block headers, each frame is decoded with the archive's dictionary, and version,
required headers, lengths and the payload digest are validated.

Defined cases: null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are always
responses; repeated rows that share the smallest id are all responses; null ids never are
the response of a revisited group unless all are null (then all are responses); a null url has
no WARC-Target-URI and reads back as null; an empty table gives no archives and no rows; other columns are ignored."""
from __future__ import annotations

import hashlib
import io
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, own_columns, scratch

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Skippable frame without content (magic 0x184D2A50, length 0); all its bytes are ASCII.
EMPTY_FRAME = b"P*M\x18\0\0\0\0"
ARCHIVE_BYTES = 32 << 20
SAMPLE_RECORDS = 200
SAMPLE_BYTES = 1 << 20
DICT_BYTES = 32 << 10
MIN_REVISIT = 100
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- records ----------------------------------------------------------------------------

def _record_id(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(record_id: str):
    m = re.fullmatch(r"<urn:x-page:(null|-?\d+)>", record_id or "")
    if not m:
        raise ValueError(f"bad record id {record_id!r}")
    return None if m[1] == "null" else int(m[1])


def make_record(page_id, url, payload: bytes, digest: str, refers_to=None, n_bytes=None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or (``refers_to`` given) a revisit without."""
    n = len(payload) if n_bytes is None else n_bytes
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises ValueError where headers, lengths or the digest are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    h = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line[:40]!r}")
        h[k.strip().lower()] = v.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise ValueError(f"no {need}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length does not fit the record")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    m = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", http)
    if not sep or not http.startswith(b"HTTP/") or not m:
        raise ValueError("no HTTP header")
    n, kind = int(m[1]), h["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown type {kind}")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (n != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not fit its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise ValueError("bad revisit")
    url = h.get("warc-target-uri")
    return {"page_id": _page_id(h["warc-record-id"]), "record_type": kind, "payload": payload, "payload_bytes": n,
            "payload_digest": digest, "refers_to": _page_id(h["warc-refers-to"]) if kind == "revisit" else None,
            "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)}


# -- archives ---------------------------------------------------------------------------

def write_archive(records: list, out) -> None:
    """Dictionary frame, then a frame per record, to the open binary file ``out``."""
    import zstandard as z
    sample, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: SAMPLE_BYTES - size])
        size += len(sample[-1])
    try:
        d = z.train_dictionary(DICT_BYTES, sample, k=256, d=8)
    except z.ZstdError:  # too little to learn from: the sample itself is the dictionary
        d = z.ZstdCompressionDict((b"".join(sample) or b"WARC/1.1")[-DICT_BYTES:], dict_type=z.DICT_TYPE_RAWCONTENT)
    raw = d.as_bytes()
    out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
    d.precompute_compress(level=LEVEL)
    c = z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True, write_content_size=True)
    for r in records:
        out.write(c.compress(r))


def frames(buf: bytes):
    """(start, end) of each Zstandard frame, by its block headers; skippable frames are passed over."""
    import zstandard as z
    at = 0
    while at < len(buf):
        if at + 8 > len(buf):
            raise ValueError("cut frame")
        magic, n = struct.unpack_from("<II", buf, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + n
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        end = at + z.frame_header_size(buf[at:at + 18])
        check = buf[at + 4] >> 2 & 1
        last = 0
        while not last:
            if end + 3 > len(buf):
                raise ValueError("cut frame")
            b = int.from_bytes(buf[end:end + 3], "little")
            last, kind, size = b & 1, b >> 1 & 3, b >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * check
        if end > len(buf):
            raise ValueError("cut frame")
        yield at, end
        at = end


def read_archive(buf: bytes):
    """Records of one archive, decoded frame by frame with the dictionary it begins with."""
    import zstandard as z
    if not buf:
        return
    d = None
    if len(buf) >= 8 and struct.unpack_from("<I", buf)[0] == DICT_MAGIC:
        raw = buf[8:8 + struct.unpack_from("<I", buf, 4)[0]]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
            raw = z.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        d = z.ZstdCompressionDict(raw)
    dc = z.ZstdDecompressor(dict_data=d)
    for a, b in frames(buf):
        yield dc.decompress(buf[a:b])


def write_warc(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives to the new folder ``folder`` and returns them as rows (path, length, content)."""
    p = own_columns(pages, page_id=("page_id", "long"), url=("url", "string"), html=("html", "string"))
    p = p.withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html").cast("long"))
    again = (p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
             .filter("k > 1 and first is not null").select("digest", "first"))
    j = p.join(again, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    j = j.select("page_id", "url", "digest", "n", refers.alias("refers_to"),
                 F.when(refers.isNull(), F.col("html")).otherwise("").cast("binary").alias("payload"))

    def run(batches):
        import pyarrow as pa
        held, size = [], 0

        def flush():
            out = io.BytesIO()
            write_archive(held, out)
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "n")]
            for row in zip(*cols):
                held.append(make_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    archives = j.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    archives.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 1).text(folder)
    return open_warc(pages.sparkSession, folder)


def open_warc(spark, folder: str) -> DataFrame:
    """(path, length, content) of the archives in a folder."""
    return spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "length", "content")


def read_warc(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Rows of all records in archives (content): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, problem (null if valid), and the payload if asked."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                buf = b.column("content")[i].as_py()
                got = []
                for raw in read_archive(buf):
                    try:
                        got.append(parse_record(raw) | {"problem": None})
                    except ValueError as e:
                        got.append({"problem": str(e)})
                for at in range(0, len(got), 1000):
                    part = got[at:at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in part], kind) for k, kind in cols],
                                                     names=[k for k, _ in cols])
    import pyarrow as pa
    cols = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string())]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
    if payloads:
        cols.append(("payload", pa.binary()))
        schema += ", payload binary"
    return archives.select("content").mapInArrow(run, schema)


def op7_warc(spark, sf_dir):
    return read_warc(write_warc(load(spark, sf_dir, "pages"), scratch(spark, "warc"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM r"""}

"""WARC archives compressed with a shared Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary, and goes
on with one frame per record.  The reader loads the dictionary from that
leading frame, decodes one frame at a time, and validates the record's version
line, its mandatory headers, Content-Length and payload digest.

Archives are rows (path, content), as Spark's `binaryFile` source gives them,
so the reader takes archive files and the writer's table alike, on any file
system.  The writer keeps an archive to about `archive_bytes` of payload.

Of records with equal payloads the one with the largest page_id is a response
and the others are revisits of it, without a body; both carry the digest and
the length of the full payload.

Defined results: a null payload is empty; a null page_id sorts before all
others, and if a group has no other, all its rows are responses; rows with
the group's largest page_id are all responses; a null url becomes
`urn:page:<page_id>`.  A url is written as it is, in UTF-8; only
control characters, and white space at its ends, become %XX.  The reader gives
urls as they stand in the archive.  A broken frame,
header, length or digest raises, unless `errors` asks for a row that says why.
Extra columns are ignored; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, small_batches

#: Fixed values of the formats: frame magics and the record version.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
EPOCH = "1970-01-01T00:00:00Z"
#: Bytes that the decoder is handed at once.
STEP = 1 << 16
#: Repeated payloads up to which their list goes to all executors: 60 bytes each.
BROADCAST_PAYLOADS = 100_000

RECORDS = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(url: str) -> str:
    """The url as it is, but for what would end or blur a header line."""
    shown = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    head, tail = len(shown) - len(shown.lstrip()), len(shown.rstrip())
    return "".join(c if head <= i < tail else "".join(f"%{b:02X}" for b in c.encode()) for i, c in enumerate(shown))


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha: str, refers_to: int | None) -> bytes:
    """One record; payload None makes a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", header_value(url) if url is not None else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, and refers_to where another row of the same
    payload has a larger page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # only payloads that occur twice or more; the sums of each task come first, so a hot payload is one row a task
    groups = rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = cut(groups, "payloads")
    small = groups.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS
    return rows.join(F.broadcast(groups) if small else groups, "sha", "left").select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") < F.col("first"), F.col("first").isNotNull() & F.col("page_id").isNull()), F.col("first")).alias("refers_to"))


def train_dictionary(pages: DataFrame, rows: int = 200, size: int = 16_384) -> bytes:
    """From the payloads of `rows` pages, those first by a hash of the id, at
    most 64 KB of each; empty if they are too few to learn from."""
    # ids first: each task sends its best `rows` ids to the driver, not their pages
    ids = [r[0] for r in pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(rows).collect()]
    sample = pages.where(F.col("page_id").isin(ids)).select("page_id", F.substring("html", 1, 65_536).alias("html")).dropDuplicates(["page_id"]).collect() if ids else []
    texts = [r.html.encode("utf-8", "surrogatepass") for r in sorted(sample, key=lambda r: ids.index(r.page_id)) if r.html]
    if len(texts) < 16 or sum(map(len, texts)) < 8 * size:
        return b""
    return zstandard.train_dictionary(size, texts).as_bytes()


def write_archives(pages: DataFrame, dictionary: bytes, archive_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """(path, content): archives of the pages, each self-contained."""
    shared = dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = zstandard.ZstdCompressionDict(shared) if shared else None
        maker = zstandard.ZstdCompressor(level=level, dict_data=tables, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_FRAME, len(shared)) + shared
        frames, held = [lead], 0

        def out() -> pa.RecordBatch:
            content = b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], ["path", "content"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                page_id, url, payload, refers_to = page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()
                frames.append(maker.compress(record(page_id, url, payload if refers_to is None else None, len(payload), digest(payload), refers_to)))
                held += len(payload) + 512
                if held >= archive_bytes:
                    yield out()
                    frames, held = [lead], 0
        if held:
            yield out()

    small_batches(pages.sparkSession)
    return with_revisits(pages).mapInArrow(run, "path string, content binary")


def frames_of(content: bytes) -> Iterator[bytes]:
    """Decoded frames after the leading dictionary frame; skippable frames in
    between are passed over."""
    at, tables, view = 0, None, memoryview(content)
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise ValueError("the dictionary frame is cut off")
        raw, at = content[8 : 8 + size], 8 + size
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        tables = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=tables) if tables else zstandard.ZstdDecompressor()
    while at < len(content):
        if len(content) - at < 8:
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        one, made, to = reader.decompressobj(), [], at
        while not one.eof and to < len(content):
            made.append(one.decompress(view[to : to + STEP]))
            to = min(to + STEP, len(content))
        if not one.eof:
            raise ValueError(f"the frame at byte {at} is cut off")
        at = to - len(one.unused_data)
        yield b"".join(made)


def parse(raw: bytes) -> dict:
    """One record, validated."""
    head, found, block = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("headers do not end")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/1."):
        raise ValueError(f"version line {version[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line {line[:40]!r}")
        headers[name.lower()] = value.strip()
    for name in MANDATORY:
        if name.lower() not in headers:
            raise ValueError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    size = int(headers["content-length"])
    if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(block) - 4} bytes")
    kind = headers["warc-type"]
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in http.split(b"\r\n")[1:])}
    length = int(fields.get("content-length", len(payload)))
    sha = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if length != len(payload):
            raise ValueError(f"the payload has {len(payload)} of {length} bytes")
        if sha and digest(payload) != sha:
            raise ValueError("the payload does not match its digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers or not sha:
            raise ValueError("a revisit has no body, a digest and a record that it refers to")
    return {"kind": kind, "id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "bytes": length, "sha": sha or digest(payload), "payload": payload if kind == "response" else None}


def page_of(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, payloads: bool = True, errors: str = "raise") -> DataFrame:
    """Records of archives (path, content); with errors="keep" what is broken
    becomes a row whose `error` says why, and its archive ends there."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for raw in frames_of(content):
                r = parse(raw)
                yield path, page_of(r["id"]), r["url"], r["kind"], page_of(r["refers_to"]), r["bytes"], r["sha"], r["payload"] if payloads else None, None
        except (ValueError, zstandard.ZstdError) as e:
            if errors == "raise":
                raise ValueError(f"{path}: {e}") from e
            yield path, None, None, None, None, None, None, None, str(e)

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                held: list[tuple] = []
                for r in rows(path.as_py(), content.as_py()):
                    held.append(r)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return archives.select("path", "content").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, archive_bytes: int = 4 << 20) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    archives = cut(write_archives(pages, train_dictionary(pages), archive_bytes), "warc")
    return read_archives(archives, payloads=False)

"""WARC archives (operator 13): pages written as records and segments, read back, reassembled and verified.

Writing. A page is an HTTP response whose body has chunked transfer framing. Its block is cut into segments of at
most `segment_bytes`: the first is the response record, the others are continuation records that name it as
WARC-Segment-Origin-ID, and the last of them carries WARC-Segment-Total-Length. Of pages with equal payloads (by
SHA-1) the one with the largest id is the response; the others are revisit records that refer to it. Records go
through Spark's own text writer, one record a row, so archives are plain WARC files (one gzip stream a file) on any
file system that Spark knows, written by its commit protocol.

Reading. Spark's text source cuts archives at the version line, so no file is ever one row; pieces that a payload
holding that line has torn apart are joined again by Content-Length, in one pass over each file's rows. Whole
records are decoded where they are. Segments are grouped by origin id, ordered by number, and their total length is
verified before the chunked framing is decoded. Payload digests are verified as well. A revisit takes its length from
the response that it refers to.

Scale: a row is a segment, never an archive. Only segments of long pages are shuffled, by origin, so a group is one
page. Copies are counted before they are shuffled: (digest, largest id) of digests that occur twice or more is
written as a table of its own, so that joins on it stay plain exchanges which adaptive execution splits where a digest
is hot, and Catalyst may broadcast it where its size on disk is under the session's threshold.

Defined cases: null html is an empty payload; rows with a null id are responses of their own unless an equal payload
has an id; repeated rows that hold the largest id are each a response; a null url leaves out the target line, and
line ends in one are percent-encoded; an empty table gives no row; other columns are never read. A record that can't
be reassembled keeps its row, with null length and digest and the reason in `problem`.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, small_batches

VERSION = b"WARC/1.1\r\n"
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Fixed value: the profile that the format's standard names for revisits by equal digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives have no clock of their own: a fixed date keeps rewritten ones equal.
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload under chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """What chunked framing holds; chunk extensions and trailers are left out. ValueError where the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            break
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2
    while (end := body.find(b"\r\n", at)) > at:
        at = end + 2
    if end < 0:
        raise ValueError("the last chunk is not closed")
    return b"".join(parts)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, with the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_records(page_id, url, html, refers_to, name: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    payload = (html or "").encode()
    base = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE)]
    about = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []
    about += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")]
    about += [("X-Page-Id", str(page_id))] if page_id is not None else []
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), *base, *about, ("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))], b"")]
    block = HTTP_HEAD + chunked(payload, chunk_bytes)
    response = [("WARC-Type", "response"), *base, *about, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        return [record(response, block)]
    out, cuts = [], range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if number == 1:
            out.append(record([*response, ("WARC-Segment-Number", "1")], part))
            continue
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{number}")
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<urn:uuid:{name}>"), ("WARC-Segment-Number", str(number))]
        out.append(record(fields + ([("WARC-Segment-Total-Length", str(len(block)))] if number == len(cuts) else []), part))
    return out


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes pages (page_id, url, html) as archives into a folder that doesn't exist yet."""
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("sha"))
    own.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first").write.parquet(f"{folder}-copies")
    twice = spark.read.parquet(f"{folder}-copies")
    told = own.join(twice, "sha", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{row}/{url}"))
                # the writer ends each row with the last line end
                out += [r[:-1] for r in page_records(page_id, url, html, refers_to, name, segment_bytes, chunk_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    told.mapInArrow(write, "record binary").select(F.col("record").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


FIELDS = {"warc-type": "kind", "warc-record-id": "id", "warc-segment-origin-id": "origin", "warc-segment-number": "number", "warc-segment-total-length": "total", "warc-payload-digest": "digest", "x-page-id": "page_id", "x-refers-to-page-id": "refers_to"}
RECORD_DDL = "kind string, id string, number long, total long, page_id long, refers_to long, digest string, block binary, problem string"
RECORD_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD_DDL.split(", "))])
PAYLOAD_DDL = "page_id long, payload_bytes long, payload_digest string, problem string"
PAYLOAD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])


def parsed(piece: bytes) -> tuple[dict, int, int] | None:
    """(fields by lower-case name, place of the block, its length) of what follows a version line; None where no head stands there."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    try:
        return fields, end + 4, int(fields["content-length"])
    except (KeyError, ValueError):
        return None


def joined_records(rows):
    """(fields, block, problem) of the pieces (file, bytes) of archives, cut at version lines, in file order."""
    held, head, at_file = b"", None, None

    def close():
        if held.strip():
            yield (head[0] if head else {}), b"", "the record is cut short" if head else "no head"

    for file, piece in rows:
        if file != at_file:
            yield from close()
            held, head, at_file = b"", None, file
        held = held + VERSION + piece if held else piece
        head = head or parsed(held)
        if head and len(held) >= head[1] + head[2]:
            fields, start, size = head
            whole = held[start + size :].startswith(b"\r\n\r\n") or held[start + size :] == b""
            yield fields, held[start : start + size], None if whole else "no end after the record"
            held, head = b"", None
        elif not head and held and not held.strip():
            held = b""
    yield from close()


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: kind, id (of a continuation: its origin's), segment number and total length (null where not segmented),
    page_id, refers_to, digest, block, problem. Rows of a gzip archive come in file order within one task."""
    pieces = spark.read.option("lineSep", VERSION.decode()).text(folder).select("_metadata.file_path", F.col("value").cast("binary").alias("piece"))

    def number(x):
        return int(x) if x is not None and x.isdigit() else None

    def read(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        out, held = [], 0
        for fields, block, problem in joined_records(rows()):
            f = {own: fields.get(name) for name, own in FIELDS.items()}
            out.append((f["kind"], f["origin"] or f["id"], number(f["number"]), number(f["total"]), number(f["page_id"]), number(f["refers_to"]), (f["digest"] or "").removeprefix("sha1:") or None, block, problem))
            held += len(block)
            if held > 4 << 20 or len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), RECORD_SCHEMA.types)], schema=RECORD_SCHEMA)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), RECORD_SCHEMA.types)], schema=RECORD_SCHEMA)

    return pieces.mapInArrow(read, RECORD_DDL)


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no HTTP head")
    head = block[:end].lower()
    fields = dict(line.partition(b":")[::2] for line in head.split(b"\r\n")[1:])
    body = block[end + 4 :]
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def decode(batches):
    """(page_id, digest, blocks, problem) to lengths and digests of payloads, verified."""
    for batch in batches:
        out = []
        for page_id, digest, blocks, problem in zip(*(c.to_pylist() for c in batch.columns)):
            size = found = None
            if problem is None:
                try:
                    payload = payload_of(b"".join(blocks))
                    size, found = len(payload), digest_of(payload)
                    if digest is not None and digest != found:
                        size, found, problem = None, None, "the payload has another digest"
                except ValueError as e:
                    problem = str(e)
            out.append((page_id, size, found, problem))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 4, PAYLOAD_SCHEMA.types)], schema=PAYLOAD_SCHEMA)


def reassembled(segments: DataFrame) -> DataFrame:
    """(page_id, digest, blocks, problem) of segmented records: continuations meet their origin by its id."""
    parts = segments.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("page_id").alias("page_id"),
        F.max("digest").alias("digest"),
        F.min("problem").alias("problem"),
    )
    in_order = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("long"), F.greatest(F.size("parts"), F.lit(1)).cast("long"))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(~in_order, "a segment is missing or repeated").when(F.col("total").isNull(), "no total length").when(size != F.col("total"), "segments do not add up to the total length")
    return parts.select("page_id", "digest", F.when(problem.isNull(), F.col("parts.block")).alias("blocks"), problem.alias("problem"))


def read_pages(spark: SparkSession, folder: str, scratch: str) -> DataFrame:
    """One row per page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, problem.

    scratch: a shared folder for the decoded responses, which revisits are joined to."""
    small_batches(spark)
    records = read_records(spark, folder)
    single = records.where("kind = 'response' and number is null").select("page_id", "digest", F.array("block").alias("blocks"), "problem")
    cut = reassembled(records.where("number is not null and kind in ('response', 'continuation')"))
    single.unionByName(cut).mapInArrow(decode, PAYLOAD_DDL).write.parquet(scratch)
    responses = spark.read.parquet(scratch)
    revisits = records.where("kind = 'revisit'").select("page_id", "refers_to", "digest")
    targets = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    targets.write.parquet(f"{scratch}-targets")
    fits = F.col("payload_bytes").isNotNull()
    followed = revisits.join(spark.read.parquet(f"{scratch}-targets"), ["refers_to", "digest"], "left").select(
        "page_id",
        "payload_bytes",
        F.when(fits, F.col("digest")).alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        "refers_to",
        F.when(~fits, "the page referred to has another payload or none").alias("problem"),
    )
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return own.unionByName(followed)


def archive_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes pages as archives into the session's shared folder and reads them back; see read_pages."""
    spark = pages.sparkSession
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{folder}/archives", segment_bytes, chunk_bytes)
    return read_pages(spark, f"{folder}/archives", f"{folder}/responses")

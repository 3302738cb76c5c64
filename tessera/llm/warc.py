"""WARC archives: write pages as segmented records, read them back, put the segments together.

Writing: payload digests decide, per group of equal payloads, which record is the response and which
are revisits of it (``first_of_payload``). A response's block (HTTP head, then the payload in chunked
transfer framing) longer than ``segment_bytes`` is cut into a first record and ``continuation`` records
(WARC-Segment-Origin-ID, WARC-Segment-Number, and WARC-Segment-Total-Length on the last). Archives are
gzip members, one per record, in files of a bounded size in the shared folder.

A record's identifier is a UUID of the archive, the digest, the page and its url; a revisit names that of
its group's response, and reading finds the response's page through it. Payloads of pages that stand alone
are written where they are read; only the rows of groups are shuffled, and the groups of very many rows
(their number is bounded by a share of the table) are sent to the tasks instead.

Reading: the files are dealt to tasks as rows and read once, in pieces, one record in memory at a time;
records not cut are decoded where they are read; the records of a cut one are grouped by origin identifier,
ordered by segment number, checked for gaps, repeats and total length, and decoded. A record or segment
set that fails a check is an error row, not a crash.

Defined results: null html is the empty payload. The response of a group is the row (or, if the table
repeats it, each such row) with the group's smallest page_id; null page_ids are responses only where a
group has no other. A revisit whose response is in none of the archives read has a null refers_to. Other
columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_groups, read, shared_folder, without_filter, written
from tessera.llm.shared_io import open_stream, write_file

SEGMENT_BYTES = 16 << 10
FILE_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
CHUNK = 4096
#: Bytes read, and at most inflated, at a time.
PIECE = 64 << 10
CRLF = b"\r\n"
EPOCH = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing (extensions and trailers allowed)."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", EPOCH), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block + CRLF + CRLF


def _line(value) -> str:
    return "" if value is None else " ".join(str(value).split())


def record_name(archive: str, sha: str, page_id: int | None, url: str | None, again: int = 0) -> str:
    """Identifier of a page's record in the archive; ``again`` counts the repeats of a row."""
    row = "\x1f".join((archive, sha, str(page_id), "" if url is None else "u" + url, str(again)))
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row)}"


def page_records(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    sha: str,
    record_id: str,
    refers_to: str | None,
    segment_bytes: int,
) -> Iterator[bytes]:
    """A page's records: a revisit where ``refers_to`` names another record, else a response, cut or not."""
    own = [("WARC-Target-URI", _line(url))] if url else []
    own += [("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-ID", _line(page_id))]
    http = [("Content-Type", "application/http; msgtype=response")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        head = status + b"Content-Length: %d\r\n\r\n" % len(payload)
        refers = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
        yield record("revisit", record_id, own + refers + http, head)
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    if len(cuts) == 1:
        yield record("response", record_id, own + http, block)
        return
    for k, at in enumerate(cuts, 1):
        part, number = block[at : at + segment_bytes], [("WARC-Segment-Number", str(k))]
        if k == 1:
            yield record("response", record_id, own + http + number, part)
            continue
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(cuts) else []
        origin = [("WARC-Segment-Origin-ID", f"<{record_id}>")]
        name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}:{k}')}"
        yield record("continuation", name, origin + number + total, part)


def inflated(stream) -> Iterator[bytes]:
    """What a file of gzip members (or a plain file) holds, in pieces of bounded size."""
    data = stream.read(PIECE)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(PIECE)
        return
    member = zlib.decompressobj(31)
    while data:
        yield member.decompress(data, PIECE)
        if member.eof:
            data, member = member.unused_data or stream.read(PIECE), zlib.decompressobj(31)
        else:
            data = member.unconsumed_tail or stream.read(PIECE)


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of each record of a file; a cut-off last record has no block."""
    pieces, held, at = inflated(stream), bytearray(), 0

    def more() -> bool:
        nonlocal at
        del held[:at]
        at = 0
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while held[at : at + 2] == CRLF or len(held) - at < 2:  # what ends the record before
            if len(held) - at >= 2:
                at += 2
            elif not more():
                return
        seen = at
        while (end := held.find(CRLF + CRLF, seen)) < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                return
        lines = held[at:end].decode("utf-8", "replace").strip().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, at = int(headers.get("content-length", 0)), end + 4
        while len(held) - at < size:
            if not more():
                yield headers, None
                return
        yield headers, bytes(held[at : at + size])
        at += size


#: A record as read. Those that are segments have a number, and wait for the others of their origin.
READ = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_record", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
        ("number", pa.int32()),
        ("total", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
    ]
)
READ_SQL = (
    "record_id string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_record string, payload binary, error string, number int, total bigint, headers map<string,string>"
)
WHOLE = READ.names[:8]


def decoded(headers: dict[str, str], block: bytes | None, error: str | None = None) -> tuple:
    """A record's row (the columns of WHOLE) from its headers and whole block."""
    page = headers.get("x-page-id", "")
    known = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = "revisit" if headers.get("warc-type") == "revisit" else "response"
    row = (headers.get("warc-record-id", "").strip("<>"), int(page) if page else None)
    if block is None or error:
        return (*row, None, known, kind, None, None, error or "record is cut off")
    head, _, body = block.partition(CRLF + CRLF)
    lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    http = {k.strip().lower(): v.strip() for k, _, v in lines}
    if kind == "revisit":
        refers = headers.get("warc-refers-to", "").strip("<>")
        return (*row, int(http.get("content-length", 0)), known, kind, refers or None, None, None)
    try:
        payload = unchunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    except ValueError as e:
        return (*row, None, known, kind, None, None, str(e))
    sha = digest(payload)
    wrong = None if sha == known or not known else "payload digest differs"
    return (*row, len(payload), sha, kind, None, payload, wrong)


def first_of_payload(pages: DataFrame, least_bytes: int) -> DataFrame:
    """A row per record to write: page_id, url, payload, sha (hex), n (of equal rows), to (page_id, url).

    ``to`` is the response that a revisit refers to, null for responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    rows = rows.withColumn("key", F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    some = rows.groupBy("sha", "key", "page_id", "url").agg(F.count("*").alias("n"))
    groups = some.groupBy("sha", "key").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min(order).alias("to"))
    groups = written(groups.where("rows > 1"))
    alone, maybe = without_filter(rows, "key", groups.select("key"))
    maybe = join_groups(maybe, groups.drop("key"), "sha", "rows", "left")
    response = F.col("to").isNull() | F.col("page_id").eqNullSafe(F.col("to.page_id"))
    maybe = maybe.withColumn("response", response | (F.octet_length("payload") < least_bytes))
    columns = ["page_id", "url", "payload", "sha"]
    nobody = F.lit(None).cast("struct<page_id:bigint,url:string>").alias("to")
    one = F.lit(1).cast("bigint").alias("n")
    named = F.struct(F.col("to.page_id").alias("page_id"), F.col("to.url").alias("url")).alias("to")
    repeated = F.col("response") & (F.coalesce(F.col("most"), F.lit(1)) > 1)
    again = maybe.where(repeated).groupBy("sha", "page_id", "url").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    return (
        alone.select(*columns, one, nobody)
        .union(maybe.where(F.col("response") & ~repeated).select(*columns, one, nobody))
        .union(maybe.where(~F.col("response")).select(*columns, one, named))
        .union(again.select(*columns, "n", nobody))
    )


def _write(folder: str, segment_bytes: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        held, size, names, sizes = [], 0, [], []

        def flush():
            nonlocal size
            # The attempt is in the name, and only the names returned are read: attempts never mix.
            path = f"{folder}/part-{part:06d}-{attempt}-{len(names):04d}.warc.gz"
            write_file(path, b"".join(held), str(attempt))
            names.append(path)
            sizes.append(size)
            held.clear()
            size = 0

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "n", "to")]
            for page, url, payload, sha, n, to in zip(*cols, strict=True):
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                refers = record_name(folder, sha, to["page_id"], to["url"]) if to else None
                for k in range(n):
                    # A revisit is named by its row too; its repeats stand in separate rows.
                    name = record_name(folder, sha, page, url, k) if refers is None else f"urn:uuid:{uuid.uuid4()}"
                    for r in page_records(page, url, payload, sha, name, refers, segment_bytes):
                        z = zlib.compressobj(1, zlib.DEFLATED, 31)
                        held.append(z.compress(r) + z.flush())
                        size += len(held[-1])
                        if size >= file_bytes:
                            flush()
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    *,
    segment_bytes: int = SEGMENT_BYTES,
    file_bytes: int = FILE_BYTES,
    least_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; their paths and sizes, as a written table."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc"
    return written(first_of_payload(pages, least_bytes).mapInArrow(_write(folder, segment_bytes, file_bytes), "path string, bytes bigint"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(READ.types)], schema=READ)


def _read(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Every record of the files: decoded, or as a segment."""
    held, size = [], 0
    for b in batches:
        for path in b.column(0).to_pylist():
            with open_stream(path) as stream:
                for headers, block in parse_records(stream):
                    if block is None or "warc-segment-number" not in headers:
                        held.append((*decoded(headers, block), None, None, None))
                    else:
                        origin = headers.get("warc-segment-origin-id", headers.get("warc-record-id", "")).strip("<>")
                        number, total = int(headers["warc-segment-number"]), headers.get("warc-segment-total-length")
                        first = list(headers.items()) if number == 1 else None
                        held.append((origin, None, None, None, None, None, block, None, number, int(total) if total else None, first))
                    size += len(held[-1][6] or b"") + 300
                    if size > limit:
                        yield _batch(held)
                        held, size = [], 0
    yield _batch(held)


def reassembled(pieces: list[tuple[int, int | None, dict | None, bytes]]) -> tuple[dict | None, bytes, str | None]:
    """First headers, whole block and what is wrong, of a record's segments in any order."""
    pieces = sorted(pieces, key=lambda p: p[0])
    headers = pieces[0][2] if pieces[0][0] == 1 else None
    block = b"".join(p[3] for p in pieces)
    if [p[0] for p in pieces] != list(range(1, len(pieces) + 1)):
        return headers, block, "segments are missing or repeated"
    if pieces[-1][1] is None:
        return headers, block, "the last segment is missing"
    if pieces[-1][1] != len(block):
        return headers, block, "total length differs"
    return headers, block, None


def _assemble(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for b in batches:
        for origin, parts in zip(b.column("record_id").to_pylist(), b.column("parts"), strict=True):
            pieces = [(p["number"], p["total"], dict(p["headers"] or []), p["payload"]) for p in parts.as_py()]
            headers, block, error = reassembled(pieces)
            held.append((origin, *decoded(headers or {}, block, error)[1:], None, None, None))
            size += len(block)
            if size > limit:
                yield _batch(held)
                held, size = [], 0
    yield _batch(held)


def read_archives(archives: DataFrame) -> DataFrame:
    """The logical records of the archives whose paths are in the first column.

    record_id, page_id, payload_bytes, payload_digest, record_type, refers_to, payload, error.
    """
    # A file is a task: they are of one size, but for the last that each writer closed.
    files = max(1, archives.count())
    path = archives.columns[0]
    found = written(archives.select(path).repartitionByRange(files, path).mapInArrow(_read, READ_SQL), "zstd")
    cut = found.where("number is not null").groupBy("record_id")
    cut = cut.agg(F.collect_list(F.struct("number", "total", "headers", "payload")).alias("parts"))
    cut = cut.mapInArrow(_assemble, READ_SQL).select(*WHOLE)
    whole = found.where("number is null").select(*WHOLE)
    records = whole.where("record_type = 'response'").union(cut)
    revisits = whole.where("record_type = 'revisit'")
    named = revisits.groupBy("refers_record").agg(F.count("*").alias("rows"))
    pages = records.select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"))
    named = written(named.join(pages.dropDuplicates(["refers_record"]), "refers_record"))
    resolved = join_groups(revisits, named, "refers_record", "rows", "left").drop("rows")
    resolved = resolved.unionByName(records.withColumn("refers_to", F.lit(None).cast("bigint")))
    return resolved.select(*WHOLE[:5], "refers_to", "payload", "error")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    checked = records.withColumn("ok", F.assert_true(F.col("error").isNull(), F.col("error")))
    return checked.where("ok is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op7_warc": r"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages),
f as (select *, min(page_id) over (partition by h) f from p),
b as (select *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || x[i + 1])::int), 4, '0')), 'string_agg', '') bits from f)
select page_id, octet_length(encode(h))::bigint payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[list_aggregate(list_transform(range(0, 5), lambda j: bits[i * 5 + j + 1]::int << (4 - j)), 'sum')::int + 1]), 'string_agg', '') payload_digest,
 case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to
from b"""
}
QUERIES = {"op7_warc": op7_warc}

"""WARC archives: a writer, and a reader that salvages damaged ones (operator 8).

Writing: payload digests are grouped first (ids and digests only, summed before the shuffle);
the few digests that occur more than once are written to the shared folder, and joined by
broadcast if their number is within ``BROADCAST_ROWS``, else by a shuffle join. Records go out
through Spark's text writer with the record end as separator, so files reach any storage that
Spark knows, a lost task leaves nothing behind, and no text is shuffled.

Archives are bounded in bytes: pages go out in ``SIZES`` classes of size, and an archive holds as
many records as ``ARCHIVE`` bytes allow for the largest page of its class (one, of those beyond).

Reading: each archive is scanned in one task. A record is valid if its version line, the four
mandatory headers, a type that the standard knows, its length, its end and (where given) SHA-1
block digest hold. After a failed check the reader goes on behind the record's stated length if a
valid record or the end lies there, so that a record within a damaged page isn't taken for one of
the archive; else at the next valid gzip member or version line. What lies between is a gap.
Archives may be plain, or gzip with a member for each record; a member of over ``MEMBER_BYTES`` is
a gap. One scan gives records and gaps; ``round_trip`` writes both and returns the records.

Null html is an empty payload; a null url leaves the target header out; a null page_id is
written as an empty id and read as null, and is never the smallest unless all are null. Rows that
tie for the smallest page_id of a payload are all responses, and repeated rows all have records.
Very long pages are written whole, in an archive of their own. Only page_id, url and html are
read, so clashing names do no harm. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stored

END = b"\r\n\r\n"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of repeated digests that are broadcast at most (some 100 bytes each).
BROADCAST_ROWS = 100_000
#: Bytes of an archive, which one task reads whole, and the largest page in bytes of each class.
ARCHIVE = 256 << 20
SIZES = (64 << 10, 4 << 20)
#: Bytes that a gzip member may hold.
MEMBER_BYTES = 1 << 30
FOUND = "path string, at bigint, record_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, url string, payload string, gap_bytes bigint, reason string"
RECORD = ["path", "at", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"]
GAP = ["path", "at", "gap_bytes", "reason"]
#: The record types of the standard, and the headers that it demands.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(s: str) -> str:
    """Line ends and controls would end the header: they are percent-encoded."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in s)


def record_text(page_id: int | None, url: str | None, html: str, first: int | None) -> str:
    """A record without its end. ``first``: the page that it revisits, if it does."""
    payload = html.encode()
    digest, revisit = sha1_base32(payload), first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http if revisit else http + html
    raw = block.encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(raw)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(raw)}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def firsts(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, first): payloads of at least ``least_bytes`` that occur more than once, with
    their smallest page_id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("n")).filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")


def write(pages: DataFrame, folder: str, least_bytes: int = 0, sizes: tuple[int, ...] = SIZES, archive: int = ARCHIVE) -> None:
    """One record for each row of ``pages`` (page_id, url, html), in subfolders of ``folder`` by
    class of size."""
    repeated = stored(firsts(pages, least_bytes), "firsts")
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    # equal_null: a null page_id beside a first one is a revisit
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = own.join(repeated, "digest", "left").select("page_id", "url", "html", revisits.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cols = [c.to_pylist() for c in b.slice(at, 256).columns]
                yield pa.RecordBatch.from_arrays([pa.array([record_text(*r) for r in zip(*cols)], pa.string())], ["value"])

    size = F.octet_length(F.coalesce("html", F.lit("")))
    limits = [-1, *sizes, 1 << 40]
    classes = [(size > low) & (size <= high) for low, high in zip(limits, limits[1:])]
    used = pages.agg(*(F.count_if(c) for c in classes)).first()
    for k, (c, n) in enumerate(zip(classes, used)):
        if n or (k == 0 and not any(used)):  # an empty table gives an empty folder
            most = max(1, archive // limits[k + 1])
            rows.filter(c).mapInArrow(run, "value string").write.option("lineSep", END.decode()).option("maxRecordsPerFile", most).text(f"{folder}/class{k}")


#: Bytes that a gzip member is read by.
PIECE = 1 << 14


class Bad(Exception):
    """A failed check; ``beyond``: where the next record begins if the stated length is right."""

    def __init__(self, why: str, beyond: int | None = None):
        super().__init__(why)
        self.beyond = beyond


def one_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Bad("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Bad("headers don't end")
    lines = data[at:stop].split(b"\r\n")
    try:
        head = {k.decode("ascii").strip().lower(): v.decode().strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        n = int(head["content-length"])
    except (UnicodeDecodeError, KeyError, ValueError):
        raise Bad("headers can't be read") from None
    start = stop + len(END)
    block, beyond = data[start : start + n], start + n + len(END)
    if n < 0 or len(block) < n:
        raise Bad("cut off")
    if data[start + n : beyond] != END:
        raise Bad("no record end")
    if any(h not in head for h in MANDATORY) or head["warc-type"] not in TYPES:
        raise Bad("a mandatory header is missing or unknown", beyond)
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != sha1_base32(block):
        raise Bad("block digest differs", beyond)
    return head, block, beyond


def valid(data: bytes, at: int) -> bool:
    try:
        one_record(data, at)
    except Bad:
        return False
    return True


def one_member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``."""
    z, view, end = zlib.decompressobj(31), memoryview(data), at
    out, size = [], 0
    try:
        while not z.eof and end < len(data):  # in pieces, as what lies behind a member is copied
            piece = view[end : end + PIECE]
            out.append(z.decompress(piece, MEMBER_BYTES + 1 - size))
            end, size = end + len(piece), size + len(out[-1])
            if size > MEMBER_BYTES:
                raise Bad("gzip member is too large")
    except zlib.error:
        raise Bad("gzip member is damaged") from None
    if not z.eof:
        raise Bad("gzip member is cut off")
    return b"".join(out), end - len(z.unused_data)


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", at, headers, block) and ("gap", start, length, reason), in order."""
    at, gap, why = 0, None, ""

    def closed(end: int) -> Iterator[tuple]:
        if gap is not None and end > gap:
            yield "gap", gap, end - gap, why

    while at < len(data):
        try:
            if data[at : at + len(MEMBER)] == MEMBER:
                plain, end = one_member(data, at)
                found, inner = [], 0
                while inner < len(plain):
                    head, block, inner = one_record(plain, inner)
                    found.append((head, block))
            else:
                head, block, end = one_record(data, at)
                found = [(head, block)]
        except Bad as e:
            if gap is None:
                gap, why = at, str(e)
            if e.beyond is not None and (e.beyond == len(data) or data[e.beyond : e.beyond + len(MEMBER)] == MEMBER or valid(data, e.beyond)):
                at = e.beyond
                continue
            after = [x for x in (data.find(b"\n" + VERSION, at), data.find(MEMBER, at + 1)) if x >= 0]
            # a version line begins after a line end; a member may begin anywhere
            at = min((x + 1 if data[x : x + 1] == b"\n" else x for x in after), default=len(data))
            continue
        yield from closed(at)
        gap = None
        for head, block in found:
            yield "record", at, head, block
        at = end
    yield from closed(len(data))


def page(value: str | None) -> str | None:
    return value[1 : -1].removeprefix(ID) or None if value else None


def row_of(path: str, at: int, head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD. A revisit has no payload of its own; its length is in its HTTP head."""
    http, _, payload = block.partition(END)
    kind = head.get("warc-type", "")
    length = len(payload)
    if kind == "revisit":
        said = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(said[0]) if said and said[0].strip().isdigit() else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return path, at, page(head.get("warc-record-id")), kind, page(head.get("warc-refers-to")), length, digest, head.get("warc-target-uri"), payload.decode("utf-8", "replace") if kind != "revisit" else None


def scan(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """FOUND: every record that can be read, and every gap (with gap_bytes and a reason)."""
    fields = [f.split() for f in FOUND.split(", ")]
    kinds = [pa.int64() if kind == "bigint" else pa.string() for _, kind in fields]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for kind, at, *found in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((path, at, *(None,) * 7, *found))
                    else:
                        row = row_of(path, at, *found)
                        rows.append((*(row if payloads else (*row[:-1], None)), None, None))
                    if len(rows) >= 512:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return archives.select("path", "content").mapInArrow(run, FOUND)


def archives(spark, folder: str) -> DataFrame:
    """path and content of the archives in ``folder`` and below."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc,gz}").option("recursiveFileLookup", "true").load(folder)


def read(spark, folder: str, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records (RECORD) and gaps (GAP) of all archives, of one scan without payloads; with
    payloads the scan isn't stored, and each of the two is a scan of its own."""
    found = scan(archives(spark, folder), payloads)
    found = found if payloads else stored(found, "scanned")
    return found.filter("reason is null").select(RECORD), found.filter("reason is not null").select(GAP)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to new archives, reads them back, and logs the gaps in a table beside the
    archives (there are none if nothing was damaged in between)."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write(pages, folder, least_bytes)
    records, gaps = read(spark, folder, payloads=False)
    gaps.write.parquet(f"{folder}-quarantine")
    return records

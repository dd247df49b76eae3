"""WARC archives with identical-payload revisits, and a salvage reader (operator 10).

Writing: each task writes its rows as gzip members, one record each, into archives of bounded size. Reading: members are
decoded one after another; where a check fails (not a gzip member, a broken stream, a checksum, a record header, a
digest) the reader searches for the next gzip magic or the next version line, goes on from there, and reports the bytes
between as a quarantined gap. Records before the damage in a member, and after a bad one in it, are kept. Time is in
proportion to an archive's bytes.

Null html is an empty payload. Null page_ids are written and read back as null; within a group of equal payloads nulls count
as smallest. Rows that share the largest page_id of their group are all responses. A very long text is one record, in an archive that
is as much larger. Empty tables give no archives and no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
_VERSION_LINE, _BLANK, _MAGIC = re.compile(rb"WARC/\d\.\d\r\n"), re.compile(rb"\r\n\r\n"), re.compile(re.escape(MAGIC))


def record(kind: str, headers: dict[str, str], body: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode(), *(f"{k}: {v}".encode() for k, v in headers.items()), b"Content-Length: %d" % len(body)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Next:
    """Places of a pattern in data, each looked for once: calls go forward."""

    def __init__(self, pattern: re.Pattern, data: bytes):
        self.pattern, self.data, self.at = pattern, data, -1

    def __call__(self, at: int) -> int:
        """The first place at or after `at`; the end of the data if there is none."""
        if self.at < at:
            m = self.pattern.search(self.data, at)
            self.at = m.start() if m else len(self.data)
        return self.at


def parse(data: bytes, at: int, blank: Next) -> tuple[dict[str, str], bytes, int, bool]:
    """Headers, body, length and whether a digest vouches for the record at `at`; ValueError where it isn't whole. blank: the empty lines of data."""
    if not (m := _VERSION_LINE.match(data, at)):
        raise ValueError("no version line")
    end = blank(m.end() - 2)
    if end >= len(data):
        raise ValueError("no end of headers")
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        headers[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise ValueError("no content length")
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record is cut")
    body = data[start:stop]
    want = headers.get("warc-block-digest")
    if want and want != "sha1:" + hashlib.sha1(body).hexdigest():
        raise ValueError("block digest differs")
    return headers, body, stop + 4 - at, bool(want)


#: Bytes that are inflated at a time, and in which steps again where that fails, so that all before the damage is read.
_STEPS = (1 << 16, 1 << 10, 1 << 5, 1)


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The plain bytes of the gzip member at `at`, its length, and what is wrong with it ('': nothing). Of a damaged member what comes before the damage."""
    z, out, pos = zlib.decompressobj(31), [], at
    for step in _STEPS:
        try:
            while pos < len(data) and not z.eof:
                before = z.copy()
                out.append(z.decompress(data[pos : pos + step]))
                pos += step
            break
        except zlib.error as e:
            z, wrong = before, str(e)
    else:
        return b"".join(out), pos - at, wrong
    if not z.eof:
        return b"".join(out), len(data) - at, "member is cut"
    return b"".join(out), min(pos, len(data)) - at - len(z.unused_data), ""


def records(data: bytes, trusted: bool = True) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record', offset, length, headers, body) and ('gap', offset, length, {'reason': ...}, b'') of plain bytes; untrusted bytes need digests."""
    line, blank = Next(_VERSION_LINE, data), Next(_BLANK, data)
    at, bad, why = 0, -1, ""
    while at < len(data):
        try:
            headers, body, size, vouched = parse(data, at, blank)
            if not (trusted or vouched):
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            at = line(at + 1)
            continue
        if bad >= 0:
            yield "gap", bad, at - bad, {"reason": why}, b""
            bad = -1
        yield "record", at, size, headers, body
        at += size
    if bad >= 0:
        yield "gap", bad, len(data) - bad, {"reason": why}, b""


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """('record', offset, length, headers, body) and ('gap', offset, length, {'reason': ...}, b'') in file order.

    Records of a gzip member have its offset and length. Whole members, plain records and gaps between them cover every byte of the file
    once. What is missing inside a member that inflates whole is a gap with the member's offset and length 0, and `inner`, its place
    in the plain bytes. Of a damaged member the records before the damage are kept (with length 0, since its bytes are a gap):
    all whole ones if it was only cut, else those with a digest, since bytes before a found error may be wrong already.
    """
    magic, line, blank = Next(_MAGIC, data), Next(_VERSION_LINE, data), Next(_BLANK, data)
    at, n, bad, why = 0, len(data), -1, ""
    until, kept = 0, []  # where a damaged member was read to, and its records: stored blocks show them once more

    def inside(plain: bytes, at: int, size: int, trusted: bool = True) -> Iterator:
        for kind, start, length, headers, body in records(plain, trusted):
            yield kind, at, size if kind == "record" else 0, headers if kind == "record" else headers | {"inner": f"{start}+{length}"}, body

    while at < n:
        found, size, reason = None, 0, "no member or version line"
        if data.startswith(MAGIC, at):
            plain, size, reason = inflate(data, at)
            if reason:
                new = [r for r in inside(plain, at, 0, reason == "member is cut") if r[0] == "record" and not (at < until and r[3:] in kept)]
                if new:
                    until, kept = at + size, [r[3:] for r in new]
                    if bad >= 0 and bad < at:
                        yield "gap", bad, at - bad, {"reason": why}, b""
                    bad = -1
                    yield from new
            else:
                found = inside(plain, at, size) if plain else iter(())
        elif _VERSION_LINE.match(data, at):
            try:
                headers, body, size, _ = parse(data, at, blank)
                if not (at < until and (headers, body) in kept):
                    found = iter([("record", at, size, headers, body)])
            except ValueError as e:
                reason = str(e)
        if found is None:
            if bad < 0:
                bad, why = at, reason
            at = min(magic(at + 1), line(at + 1))
            continue
        if bad >= 0:
            yield "gap", bad, at - bad, {"reason": why}, b""
            bad = -1
        yield from found
        at += size
    if bad >= 0:
        yield "gap", bad, n - bad, {"reason": why}, b""


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to): of equal payloads of LEAST_BYTES or more the largest page_id is kept.

    Only digests that occur more than once go to the table that pages are joined with; Spark broadcasts it while its files are
    below the broadcast threshold, else both sides shuffle by digest and adaptive execution splits a hot one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "utf-8"))).withColumn("large", F.octet_length("html") >= LEAST_BYTES)
    kept = rows.where("large").groupBy("payload_digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "keep")
    kept = common.materialise(kept, "warc-groups")
    refers = F.when(F.col("large") & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return rows.join(kept, "payload_digest", "left").select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def _record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def page_record(page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """A response with the payload, or a revisit with its HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers else http + payload
    headers = {
        "WARC-Record-ID": _record_id(page, digest), "WARC-Date": date, "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{hashlib.sha1(body).hexdigest()}",
        "X-Payload-Length": str(len(payload)),
    } | ({} if page is None else {"X-Page-ID": page})
    if refers:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers, digest), "X-Refers-To-Page": refers}
    return record("revisit" if refers else "response", headers, body)


def write_archives(classified: DataFrame, out: str, archive_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives of about archive_bytes under `out`; their manifest (name, records, bytes) is a written table.

    File names hold a number of the attempt of the task that wrote them, and the manifest names those of successful attempts only: what a
    lost or repeated attempt leaves behind is never read.
    """
    common.small_batches(classified.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, attempt, n, f, size, count = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, 0, 0
        for pdf in batches:
            for page, url, html, digest, refers in pdf.itertuples(index=False, name=None):
                if f is None:
                    name, n = f"{task:07d}-{n:05d}-{attempt}.warc.gz", n + 1
                    f, size, count = common.open_output(f"{out}/{name}"), 0, 0
                data = member(page_record(page, url, html.encode("utf-8"), digest, refers, date))
                f.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    f.close()
                    f = None
                    yield pd.DataFrame({"name": [name], "records": count, "bytes": size})
        if f is not None:
            f.close()
            yield pd.DataFrame({"name": [name], "records": count, "bytes": size})

    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to")]
    return common.materialise(classified.select(*text).mapInPandas(write, "name string, records long, bytes long"), "warc-manifest")


SCHEMA = "archive string, kind string, offset long, length long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, out: str, manifest: DataFrame | None = None, with_payload: bool = False) -> DataFrame:
    """All records and quarantined gaps (kind: record or gap) of the archives under `out` that the manifest names; without one, of all *.warc and *.warc.gz.

    A payload's digest is computed again where the record has it.
    """
    number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None

    def rows_of(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for kind, at, size, h, body in salvage(content):
            payload, own = None, h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            length = number(h.get("x-payload-length"))
            if kind == "record" and h.get("warc-type") == "response":
                payload = body.partition(b"\r\n\r\n")[2]
                length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                if own and digest != own:
                    kind, h = "gap", h | {"reason": "payload digest differs"}
                own = digest
            rows.append((name, kind, at, size, h.get("reason"), number(h.get("x-page-id")), h.get("warc-target-uri"), length, own, h.get("warc-type"), number(h.get("x-refers-to-page")), *((payload,) if with_payload else ())))
            held += len(payload or b"") * with_payload
            if len(rows) >= 5000 or held > 1 << 24:
                yield _frame(rows, with_payload)
                rows, held = [], 0
        if rows:
            yield _frame(rows, with_payload)

    def read_named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["name"]:
                with common.open_input(f"{out}/{name}") as f:
                    content = f.read()
                yield from rows_of(name, content)

    def read_found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield from rows_of(path.rsplit("/", 1)[-1], content)

    schema = SCHEMA + (", payload binary" if with_payload else "")
    if manifest is not None:
        files = max(1, manifest.count())
        return manifest.select("name").repartition(min(files, 20_000), "name").mapInPandas(read_named, schema)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{warc,warc.gz}").load(out).select("path", "content")
    return files.mapInPandas(read_found, schema)


def _frame(rows: list[tuple], with_payload: bool) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")] + ["payload"] * with_payload)
    return pdf.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch(spark, "warc")
    manifest = write_archives(classify(common.table(spark, sf_dir, "pages")), out)
    return read_archives(spark, out, manifest).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has SHA-1 and the same rule is a window over equal payloads.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS b FROM pages),
d AS (SELECT page_id, b, sha1(html) AS h FROM p),
g AS (SELECT *, CASE WHEN b >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS keep FROM d)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id <> keep THEN keep END AS refers_to
FROM g
"""

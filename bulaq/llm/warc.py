"""WARC files, index first: write offset, length, URL and digest per record, then read selected records by ranges.

Every record is a gzip member of its own. Tasks write files into the cluster's shared folder under a name that no
other attempt has; the index rows of what they wrote are committed as a table, so a file of a lost attempt is named
nowhere and never read. Archives of others, compressed by record or not at all, are indexed by reading them once. A
selection of an index is sorted by file and offset, ranges that touch or lie at most ``GAP`` bytes apart become one
read, and one pass yields the records.

Defined results: a null page is a record without content, a null URL a record without that header, and both come
back as nulls; repeated rows are records of their own; an empty table gives no records; other columns are not
written, whatever their names. Digests in sha256, sha1 or md5, hexadecimal or base32, are verified and an error if they
differ; others are passed on. Of an HTTP response the content is given, without its transfer and content coding;
bytes that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column_of, shared_dir, staged

GAP = 65_536
#: Bytes that one coalesced read has at most, unless a single record has more.
READ_BYTES = 8_000_000
#: Bytes of selected records for one task; the index rows are too small for their number to tell.
TASK_BYTES = 16_000_000
INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string"


#: Names of file systems that Hadoop and Arrow call differently.
_SCHEMES = (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/"))


def arrow_uri(uri: str) -> str:
    for theirs, ours in _SCHEMES:
        if uri.startswith(theirs):
            return ours + uri[len(theirs) :].lstrip("/")
    return uri


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(uri))


def record(page_id: int | None, url: str | None, html: str | None) -> tuple[bytes, str | None, str | None]:
    """One resource record, compressed as a gzip member, with its digest and the URL as the record has it."""
    body = (html or "").encode("utf-8", "surrogatepass")
    digest = None if html is None else hashlib.sha256(body).hexdigest()
    url = None if url is None else url.translate({10: "%0A", 13: "%0D"}).strip()
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {url}"] if url is not None else []
    lines += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}"] if digest else []
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0), digest, url


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with names in lower case, body) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers.get("content-length", 0))]


def same_digest(digest: str, body: bytes) -> bool:
    """Whether ``body`` has that digest (name:value); true for names that are not known."""
    name, _, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha256", "sha1", "md5"):
        return True
    own = hashlib.new(name, body)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def payload(headers: dict[str, str], body: bytes) -> tuple[bytes, bytes]:
    """(payload as the digest counts it, content without codings) of a record's body."""
    if not headers.get("content-type", "").startswith("application/http"):
        return body, body
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = {a.strip().lower(): b.strip().lower() for a, _, b in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    content = rest
    try:
        if "chunked" in fields.get("transfer-encoding", ""):
            parts, at = [], 0
            while True:
                end = content.index(b"\r\n", at)
                size = int(content[at:end].split(b";")[0], 16)
                if not size:
                    break
                parts.append(content[end + 2 : end + 2 + size])
                at = end + 4 + size
            content = b"".join(parts)
        if fields.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
            content = zlib.decompress(content, 47)
    except (ValueError, zlib.error):  # the archive has undone the coding and kept the header
        pass
    return rest, content


def write(pages: DataFrame) -> DataFrame:
    """INDEX of the files that now hold all rows of ``pages`` (page_id, url, html); staged."""
    base = f"{shared_dir(pages.sparkSession)}/warc/{uuid.uuid4().hex}"
    rows = pages.select(column_of(pages, "page_id", "bigint"), column_of(pages, "url", "string"), column_of(pages, "html", "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            found = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    where, path = _place(name)
                    where.create_dir(path.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(path, compression=None)
                raw, digest, told = record(page, url, html)
                out.write(raw)
                found.append((name, size, len(raw), page, told, digest))
                size += len(raw)
            yield _index_rows(found)
        if out is not None:
            out.close()

    return staged(rows.mapInArrow(run, INDEX))


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
    return pa.RecordBatch.from_arrays(cols, names=["file", "offset", "length", "page_id", "url", "digest"])


def members(source, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, or of each record of one that is not compressed."""
    at = 0
    data = source.read(chunk)
    if data[:5] == b"WARC/":
        yield from _plain(source, data, chunk)
        return
    while data:
        d, parts, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not data:
                raise EOFError("a member is cut short")
            parts.append(d.decompress(data))
            used += len(data) - len(d.unused_data)
            data = d.unused_data or (b"" if d.eof else source.read(chunk))
        yield at, used, b"".join(parts)
        at += used
        data = data or source.read(chunk)


def _plain(source, data: bytes, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while data.strip(b"\r\n"):
        while (head := data.find(b"\r\n\r\n")) < 0:
            more = source.read(chunk)
            if not more:
                raise EOFError("a record is cut short")
            data += more
        size = int(parse(data[: head + 4])[0].get("content-length", 0))
        need = head + 4 + size + 4
        parts, have = [data], len(data)
        while have < need and (more := source.read(max(chunk, need - have))):
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        if have < need - 4:
            raise EOFError("a record is cut short")
        yield at, min(need, have), data[:need]
        at, data = at + need, data[need:] or source.read(chunk)


def _page_id(headers: dict[str, str]) -> int | None:
    page = headers.get("warc-page-id", "")
    return int(page) if page.lstrip("-").isdecimal() else None


def index(files: DataFrame) -> DataFrame:
    """INDEX for all records of the files that the column ``file`` names; made from the files alone, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                where, path = _place(name)
                rows = []
                with where.open_input_stream(path, compression=None) as source:
                    for offset, length, raw in members(source):
                        h, _ = parse(raw)
                        rows.append((name, offset, length, _page_id(h), h.get("warc-target-uri"), h.get("warc-payload-digest", ":").partition(":")[2] or None))
                        if len(rows) == 10_000:
                            yield _index_rows(rows)
                            rows = []
                yield _index_rows(rows)

    n = max(1, files.count())
    spread = files.select("file").repartition(min(n, 10_000), "file")
    return staged(spread.mapInArrow(run, INDEX))


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """(first row, end row, bytes) of the reads that cover sorted (offset, length) rows."""
    out: list[tuple[int, int, int]] = []
    i = 0
    while i < len(rows):
        start, end, j = rows[i][0], rows[i][0] + rows[i][1], i + 1
        while j < len(rows) and rows[j][0] - end <= gap and max(end, sum(rows[j])) - start <= most:
            end, j = max(end, sum(rows[j])), j + 1
        out.append((i, j, end - start))
        i = j
    return out


def read(selected: DataFrame) -> DataFrame:
    """(page_id, url, digest, html) of the selected rows of an index."""
    rows = selected.select("file", "offset", "length")
    tasks = int((rows.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES) + 1
    rows = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            spans = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                where, path = _place(names[lo])
                with where.open_input_file(path) as source:
                    for i, j, size in ranges(spans[lo:hi]):
                        start = spans[lo + i][0]
                        data = memoryview(source.read_at(size, start))
                        got = []
                        for offset, length in spans[lo + i : lo + j]:
                            raw = bytes(data[offset - start : offset - start + length])
                            h, body = parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                            digest = h.get("warc-payload-digest")
                            counted, content = payload(h, body)
                            if digest is not None and not same_digest(digest, counted) and not same_digest(digest, content):
                                raise ValueError(f"digest of the record at {offset} of {names[lo]} differs")
                            empty = digest is None and not content
                            got.append((_page_id(h), h.get("warc-target-uri"), digest and digest.partition(":")[2], None if empty else content.decode("utf-8", "replace")))
                        cols = zip(*got)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["page_id", "url", "digest", "html"])
                lo = hi

    return rows.mapInArrow(run, "page_id bigint, url string, digest string, html string")


def first_of_each(found: DataFrame) -> DataFrame:
    """Of the records with one digest the one with the smallest (page_id, url, file, offset); all those without digest."""
    key = F.struct("page_id", "url", "file", "offset", "length")
    best = found.where("digest is not null").groupBy("digest").agg(F.min(key).alias("k")).select("k.file", "k.offset", "k.length")
    return best.union(found.where("digest is null").select("file", "offset", "length"))


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written, indexed, reduced to one record per digest and read back."""
    return read(staged(first_of_each(write(pages))))


SQL = """
    WITH p AS (SELECT page_id, url, html, sha256(html) AS digest FROM pages)
    SELECT page_id, url, digest, html FROM p
    QUALIFY digest IS NULL OR row_number() OVER (PARTITION BY digest ORDER BY page_id, url) = 1"""

"""WARC archives with a two-level capture index.

``write`` stores one record for each page, each its own gzip member, in one archive file for each task. The
capture index has a line for each record under the key (reversed-host URL, page id), ordered by key, file and offset: lines are
range-sorted over tasks and written as compressed blocks; each index part keeps a sparse directory (first key, offset and
length of every block), and a small top table holds the first key of each part. ``lookup`` binary-searches
the top table, then the part's directory, then the block, and ``read`` fetches only the records' byte ranges.

Files are written by tasks through ``pyarrow.fs`` under names with the task attempt, and only names that
successful attempts reported are ever read, so lost executors leave unused files but no broken ones.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import new_path, written

BLOCK_LINES, CACHED_BLOCKS, LEVEL = 1024, 64, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id bigint, url string, record_type string, digest string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_digest string"


@dataclass(frozen=True)
class Archive:
    """Where an archive's files are: ``captures`` lists the records, ``top`` the index parts."""

    path: str
    captures: DataFrame
    top: DataFrame


def surt(url: str | None) -> str:
    """Reversed-host form of a URL: ``http://a.example.com/x?y`` is ``com,example,a)/x?y``; null is ``)``.

    Scheme, user, fragment and default ports go; host is lower-cased. What does not parse stays as it is.
    """
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else "//" + text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{at}){parts.path or '/' * bool(host)}" + (f"?{parts.query}" if parts.query else "")


def _key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)}\x00{-1 if page_id is None else page_id:020d}"


def with_surt(df: DataFrame, url_col: str = "url") -> DataFrame:
    keyed = F.arrow_udf(lambda urls: pa.array([surt(u) for u in urls.to_pylist()], pa.string()), "string")
    return df.withColumn("surt", keyed(url_col))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _record(page_id, url, date, kind, response, digest, payload: bytes) -> bytes:
    uri = (url or "urn:none").encode("utf-8", "replace").translate(None, b"\r\n")
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Target-URI: " + uri, b"WARC-Date: " + date.encode(), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http;msgtype=response"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <urn:page:%s>" % str(response).encode()]
        body = http
    else:
        body = http + payload
    return b"\r\n".join([*head, b"Content-Length: %d" % len(body), b"", body]) + b"\r\n\r\n"


def _parse(raw: bytes) -> dict:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.decode().partition(": ") for line in head.split(b"\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    fields["payload"] = body.partition(b"\r\n\r\n")[2]
    return fields


def _page(urn: str | None) -> int | None:
    text = (urn or "")[len("<urn:page:") : -1]
    return None if text in ("", "None") else int(text)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", block_lines: int = BLOCK_LINES) -> Archive:
    """Write ``pages`` as archives and index under ``path`` (default: a new folder in the shared one).

    Of the pages with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest id is
    stored as response, the others as revisit records that refer to it. Null bodies are empty payloads, null
    URLs are stored as ``urn:none`` and sort first. Repeated rows are stored as often as they occur; several
    rows with the largest id are all responses. Rows with a null id refer to the response if there is one
    with an id. Other columns are not read. An empty table writes no archive file.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"), F.sha1(body).alias("sha"))
    first = rows.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("times")).where("times > 1").select(F.col("sha").alias("s"), "response")
    typed = rows.join(first, F.col("sha") == F.col("s"), "left")
    revisit = F.col("s").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")) & (F.octet_length("html") >= min_revisit_bytes)
    typed = typed.select("page_id", "url", "html", "sha", F.when(revisit, "revisit").otherwise("response").alias("kind"), "response")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at, name = TaskContext.get(), None, 0, ""
        for batch in batches:
            lines = []
            for page_id, url, html, sha, kind, response in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                    fs, root = _open(path)
                    fs.create_dir(root)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(_record(page_id, url, date, kind, response, digest, html.encode())) + pack.flush()
                out.write(member)
                lines.append((_key(url, page_id), page_id, url, kind, digest, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*lines) if lines else [[]] * 8, _types)], names=_names)
        if out is not None:
            out.close()

    captures = written(typed.mapInArrow(store, CAPTURE), "captures")
    return Archive(path, captures, _index(captures, path, block_lines))


_names = ["key", "page_id", "url", "record_type", "digest", "file", "offset", "length"]
_types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _index(captures: DataFrame, path: str, block_lines: int) -> DataFrame:
    """Write index parts; the result has (first_key, file, directory_offset, directory_length, lines) of each."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lines, directory, at, first, count, out = TaskContext.get(), [], [], 0, None, 0, None
        fs, root = _open(path)
        name = f"index-{task.partitionId():05d}-{task.taskAttemptId()}.cdxj.gz"

        def flush() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), LEVEL)
            out.write(block)
            directory.append((lines[0][0], at, len(block)))
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(root)
                    out, first = fs.open_output_stream(f"{root}/{name}", compression=None), row[0]
                lines.append(row)
                count += 1
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            sparse = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), LEVEL)
            out.write(sparse)
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [first], "file": [name], "directory_offset": [at], "directory_length": [len(sparse)], "lines": [count]})

    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(store, "first_key string, file string, directory_offset bigint, directory_length bigint, lines bigint"), "index")


class _Reader:
    """Open files and recent blocks of one archive, inside a task."""

    def __init__(self, path: str, top: list[tuple]):
        self.fs, self.root = _open(path)
        self.top, self.files, self.parts, self.blocks = top, OrderedDict(), OrderedDict(), OrderedDict()

    def bytes_at(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= CACHED_BLOCKS:
                self.files.popitem(last=False)[1].close()
            self.files[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(length, offset)

    def find(self, part: int, key: str) -> Iterator[list]:
        """The capture lines with this key in one index part: a binary search in its sparse directory, one in the first block
        that can hold the key, then on while blocks begin with it."""
        _, name, offset, length = self.top[part]
        if name not in self.parts:
            if len(self.parts) >= CACHED_BLOCKS:
                self.parts.popitem(last=False)
            directory = json.loads(zlib.decompress(self.bytes_at(name, offset, length)))
            self.parts[name] = ([d[0] for d in directory], directory)
        firsts, directory = self.parts[name]
        b = max(0, bisect_left(firsts, key) - 1)
        while b < len(firsts) and firsts[b] <= key:
            if (name, b) not in self.blocks:
                if len(self.blocks) >= CACHED_BLOCKS:
                    self.blocks.popitem(last=False)
                rows = [json.loads(x) for x in zlib.decompress(self.bytes_at(name, *directory[b][1:])).decode().split("\n")]
                self.blocks[name, b] = ([r[0] for r in rows], rows)
            keys, rows = self.blocks[name, b]
            yield from rows[bisect_left(keys, key) : bisect_right(keys, key)]
            b += 1


def lookup(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The lines of the capture index for the distinct ids and URLs of ``wanted``: (page_id, url, record_type, digest, file,
    offset, length), one for each stored record.

    The first key of each index part (a row for each part) is broadcast; a key that fills several parts is looked up in
    each of them, by different tasks.
    """
    top = [tuple(r) for r in archive.top.select("first_key", "file", "directory_offset", "directory_length").orderBy("first_key", "file").collect()]
    held = wanted.sparkSession.sparkContext.broadcast(top)
    path = archive.path

    @F.arrow_udf("array<int>")
    def parts(keys: pa.Array) -> pa.Array:
        firsts = [t[0] for t in held.value]
        return pa.array([list(range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k))) for k in keys.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf("string")
    def keys(urls: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([_key(u, i) for u, i in zip(urls.to_pylist(), ids.to_pylist())], pa.string())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(path, held.value)
        for batch in batches:
            lines = []
            for part, key, url in zip(*(c.to_pylist() for c in batch.columns)):
                for x in reader.find(part, key):
                    if x[2] == url:  # URLs with one reversed-host form share a key
                        lines.append(x[1:])
                    if len(lines) == 4096:
                        yield _lines(lines)
                        lines = []
            yield _lines(lines)

    asked = wanted.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url")).distinct()
    keyed = asked.select(keys("url", "page_id").alias("key"), "url").select("key", "url", F.explode(parts("key")).alias("part"))
    return keyed.repartitionByRange("part", "key").sortWithinPartitions("part", "key").select("part", "key", "url").mapInArrow(search, CAPTURE.partition(", ")[2])


def _lines(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _types[1:])], names=_names[1:])


def read(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every stored record of the distinct ids and URLs of ``wanted``: (page_id, url, record_type, refers_to,
    payload, payload_digest); revisit records have an empty payload. Rows that are not stored are left out; an id and URL that
    was stored several times gives a row for each record.

    The lines found in the index are range-sorted by file and offset (lines only), so that a task reads neighbouring records.
    """
    path = archive.path

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(path, [])
        for batch in batches:
            lines = list(zip(*(c.to_pylist() for c in batch.columns)))
            for a in range(0, len(lines), 256):
                rows = []
                for page_id, url, kind, _, name, offset, length in lines[a : a + 256]:
                    got = _parse(zlib.decompress(reader.bytes_at(name, offset, length), 31))
                    digest = got["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode() != digest:
                        raise ValueError(f"record of page {page_id} in {name} at {offset} does not match its digest")
                    rows.append((page_id, url, got["warc-type"], _page(got.get("warc-refers-to")), got["payload"], digest))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "record_type", "refers_to", "payload", "payload_digest"])

    return lookup(archive, wanted, id_col, url_col).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)


def digests(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Read records back as (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Size and digest are those of the full payload: revisit records take the size of the response read with
    the same digest.
    """
    got = read(archive, wanted, id_col, url_col).select("page_id", F.octet_length("payload").cast("bigint").alias("own"), "payload_digest", "record_type", "refers_to")
    got = written(got, "records")
    full = got.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("own").alias("full"))
    revisits = got.where("record_type = 'revisit'").join(full, F.col("payload_digest") == F.col("d"), "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return got.where("record_type = 'response'").select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", "refers_to").unionByName(revisits)

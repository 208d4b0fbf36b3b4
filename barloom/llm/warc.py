"""Operator 4: WARC archives of pages, and a two-level capture index over them.

:func:`write_archives` writes one gzip member per page (WARC/1.0).  Of pages with
equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the largest
page_id is a ``response`` and the others are ``revisit`` records that refer to it
(with the HTTP header, without the payload).  :func:`build_index` sorts the captures
by reversed-host URL key and page_id into ranges; each range is a file of
compressed blocks of ``BLOCK_LINES`` lines, with a sparse directory of the blocks'
first keys beside it.  :func:`lookup` finds the range, then the block, then the line by
binary search, and reads just the record's bytes from its archive.

Files go to a folder that all executors share, through pyarrow's file systems.
Their names are the task attempt's own, and the captures and the index name them, so
attempts that are lost, late or speculative never touch another's files.

Defined cases: a null html is empty; a null url has the key ``-``; pages with a null
page_id are responses, are referred to by none, and are found by their url; rows
repeated in full are a record each; urls that can't be parsed are keys as they are;
an empty table gives no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import attempt, columns, file_system, in_batches, keep, partitions, scratch

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 256
DATE = "2024-01-01T00:00:00Z"
_NONE = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_ENTRY = "key string, page_id long, file string, offset long, size long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``com,example,www)/a?b``; fragments, users and default ports go."""
    if url is None:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(u.scheme.lower())
    tail = f":{port}" if port and port != default else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){u.path or '/'}{'?' + u.query if u.query else ''}"


class _Output:
    """A file and how much was written; its name holds the attempt's, and the rows that the winning attempt returns hold it."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str) -> None:
        self.stream, self.size = fs.open_output_stream(f"{root}/{name}", compression=None), 0

    def write(self, data: bytes) -> int:
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def record(page_id: int | None, place: str, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:page:none:{place}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP header and payload of a record (of its gzip member's bytes)."""
    data = zlib.decompress(raw, 47)
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[at + 4 : at + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
    return {"head": head, "http": http, "payload": block[cut + 4 :]}


def _archive(folder: str):
    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        part, number, out, rows = TaskContext.get().partitionId(), 0, None, []

        def flush():
            k = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(k[0], pa.string()), pa.array(k[1], pa.int64()), pa.array(k[2], pa.string()), pa.array(k[3], pa.int64()), pa.array(k[4], pa.int64())], names=["key", "page_id", "file", "offset", "size"])

        for b in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"pages-{part:06d}-{number:04d}-{attempt()}.warc.gz"
                    out = _Output(fs, root, name)
                    number += 1
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = z.compress(record(page_id, f"{name}:{out.size}", url, (html or "").encode(), digest, refers_to)) + z.flush()
                rows.append((url_key(url), page_id, name, out.write(raw), len(raw)))
                if out.size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield flush()
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives; rows (key, page_id, file, offset, size), one for each."""
    pages = columns(pages, page_id="long", url="string", html="string")
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.withColumns({"digest": F.sha1(body), "n": F.octet_length(body)})
    equal = pages.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies"))
    equal = keep(equal.where("copies > 1").drop("copies"), "equal-payloads")
    named = pages.join(equal, ["digest", "n"], "left")
    refers = F.when(F.col("page_id") != F.col("response"), F.col("response"))
    rows = named.select("page_id", "url", "html", "digest", refers.alias("refers_to")).transform(in_batches, _archive(folder), _ENTRY)
    return keep(rows, "captures")


def _line(key: str, page_id: int | None, file: str, offset: int, size: int) -> bytes:
    return "\t".join((key.replace("\t", "%09").replace("\n", "%0A"), "" if page_id is None else str(page_id), file, str(offset), str(size))).encode() + b"\n"


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.replace("\t", "%09").replace("\n", "%0A").encode(), _NONE if page_id is None else page_id


def _index(folder: str, lines: int):
    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"index-{TaskContext.get().partitionId():06d}-{attempt()}"
        out, directory, held, ends = None, [], [], []

        def block():
            raw = gzip.compress(b"".join(_line(*row) for row in held), 1, mtime=0)
            directory.append(_line(held[0][0], held[0][1], "", out.write(raw), len(raw)))

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "size")), strict=True):
                if out is None:
                    out = _Output(fs, root, f"{name}.blocks")
                    ends.append(row[:2])
                held.append(row)
                if len(held) == lines:
                    block()
                    last, held = held[-1], []
        if held:
            block()
            last = held[-1]
        if out is not None:
            out.close()
            sparse = _Output(fs, root, f"{name}.directory")
            sparse.write(b"".join(directory))
            sparse.close()
            first, last = _order(*ends[0]), _order(*last[:2])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([first[0].decode()]), pa.array([first[1]]), pa.array([last[0].decode()]), pa.array([last[1]]), pa.array([len(directory)])],
                names=["name", "first_key", "first_id", "last_key", "last_id", "blocks"],
            )

    return run


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index of ``captures`` to ``folder``; one row for each range, with its first and last key."""
    parts = partitions(captures.sparkSession)
    at = F.coalesce("page_id", F.lit(_NONE))
    ranged = captures.repartitionByRange(parts, F.col("key"), at).sortWithinPartitions("key", at, "file", "offset")
    return keep(ranged.transform(in_batches, _index(folder, lines), "name string, first_key string, first_id long, last_key string, last_id long, blocks long"), "index")


class Index:
    """Reads captures by key: binary search over ranges, then blocks, then lines."""

    def __init__(self, folder: str, ranges: list[tuple]) -> None:
        self.fs, self.root = file_system(folder)
        self.ranges = sorted(ranges, key=lambda r: (r[1], r[2]))
        self.last = [(r[3], r[4]) for r in self.ranges]
        self.cache: OrderedDict = OrderedDict()

    def _cached(self, key, load, most: int = 64):
        if key not in self.cache:
            while len(self.cache) >= most:
                self.cache.popitem(last=False)
            self.cache[key] = load()
        self.cache.move_to_end(key)
        return self.cache[key]

    @staticmethod
    def _rows(raw: bytes) -> tuple[list, list]:
        rows = [line.split(b"\t") for line in raw.split(b"\n")[:-1]]
        return [(r[0], int(r[1]) if r[1] else _NONE) for r in rows], rows

    def _read(self, name: str, offset: int | None = None, size: int | None = None) -> bytes:
        if offset is None:
            with self.fs.open_input_stream(f"{self.root}/{name}") as f:
                return f.read()
        f = self._cached(("file", name), lambda: self.fs.open_input_file(f"{self.root}/{name}"))
        return f.read_at(size, offset)

    def entries(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, size) of the captures with this key and page_id."""
        want = _order(key, page_id)
        k = bisect.bisect_left(self.last, want)
        while k < len(self.ranges) and (self.ranges[k][1], self.ranges[k][2]) <= want:
            name = self.ranges[k][0]
            firsts, rows = self._cached(("directory", name), lambda: self._rows(self._read(f"{name}.directory")))  # noqa: B023
            b = max(0, bisect.bisect_left(firsts, want) - 1)
            while b < len(firsts) and firsts[b] <= want:
                offset, size = int(rows[b][3]), int(rows[b][4])
                keys, lines = self._cached(("block", name, b), lambda: self._rows(gzip.decompress(self._read(f"{name}.blocks", offset, size))))  # noqa: B023
                at = bisect.bisect_left(keys, want)
                while at < len(keys) and keys[at] == want:
                    yield lines[at][2].decode(), int(lines[at][3]), int(lines[at][4])
                    at += 1
                if at < len(keys):
                    break
                b += 1
            k += 1

    def record(self, file: str, offset: int, size: int) -> dict:
        return parse(self._read(file, offset, size))


def lookup(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Read the captures of the distinct ``wanted`` (url, page_id) back, dealt in key order.

    Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to).
    """
    names = ("name", "first_key", "first_id", "last_key", "last_id")
    ranges = [(r["name"], r["first_key"].encode(), r["first_id"], r["last_key"].encode(), r["last_id"]) for r in index.select(*names).collect()]

    def run(batches):
        found = Index(folder, ranges)
        for b in batches:
            rows = []
            for url, page_id in zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                for entry in found.entries(url_key(url), page_id):
                    r = found.record(*entry)
                    head = r["head"]
                    if head.get("WARC-Target-URI") != (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")):
                        continue
                    name, refers = head["WARC-Record-ID"][1:-1], head.get("WARC-Refers-To")
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size = int(r["http"]["Content-Length"])
                    if refers is None and (len(r["payload"]) != size or hashlib.sha1(r["payload"]).hexdigest() != digest):
                        raise ValueError(f"damaged record {name}")
                    own = name.removeprefix("urn:page:")
                    rows.append((None if own.startswith("none") else int(own), url, size, digest, head["WARC-Type"], refers and int(refers[1:-1].removeprefix("urn:page:"))))
            k = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(k, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    wanted = columns(wanted, url="string", page_id="long").distinct()
    parts = partitions(wanted.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[^/]*//(?:[^/@]*@)?([^/:?#]*)", 1))
    dealt = wanted.repartitionByRange(parts, F.reverse(F.split(host, r"\.")), "url", "page_id").sortWithinPartitions(F.reverse(F.split(host, r"\.")), "url", "page_id")
    return dealt.transform(in_batches, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, index them, and read every page back through the index."""
    folder = scratch(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    index = build_index(captures, folder)
    return lookup(pages, index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def members(raw: bytes) -> Iterator[bytes]:
    """The records of a whole archive, in order."""
    stream = io.BytesIO(raw)
    while data := stream.read():
        z = zlib.decompressobj(47)
        yield z.decompress(data)
        stream.seek(stream.tell() - len(z.unused_data))

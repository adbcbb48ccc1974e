"""WARC archives of pages, and a two-level index of their captures.

Every task writes its pages to archives of its own, one gzip member a record,
so that a record can be read by its range alone. Of records with equal payloads
one is a *response* with the payload, the others are *revisits* that name it.

The index is sorted by the url with its host reversed (``com,example)/path``),
so that a site lies together, and cut into blocks of lines that are compressed
one by one. A sparse directory has the first line of each block, one directory
a part of the index; the parts themselves are known by their first lines, as
many as the sort has partitions. A search goes by bisection over parts, blocks
and lines and reads one block; the record is then read by its range. Searches
are sorted first, so a task reads each block once and archives front to back.

A task that is run again writes files of new names, and only those of the
attempt that ended are named in the index; what a lost one leaves is never read.
Files are opened by pyarrow's file systems from the shared folder's address.

Defined results: a null html is an empty payload, a null url has the key ``""``,
one without ``://`` has no host and the key ``)url``; null ids come last and are
not referred to; rows that share the smallest id of a payload are all responses,
and so are rows of a payload whose ids are all null; repeated rows have a record
each; line breaks of an url are escaped in record headers only; payloads of any
length are one record; an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm.common import small_batches
from kinetable.settings import checkpointed, shared_folder

# fixed values of the format
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PAGE, KEY_HEADER = "urn:page:", "X-Refers-To-Key"

CAPTURE = "key string, id long, file string, offset long, length long, type string, bytes long, digest string"
LEAST_BYTES, ROLL, LINES = 100, 1 << 30, 3000
MARKS = "),:"  # what follows a host in a key: its path, a subdomain, a port


@dataclass(frozen=True)
class Archive:
    """Where the files lie, and the first line and the names of every part of the index, in order."""

    folder: str
    firsts: tuple[tuple, ...]
    parts: tuple[str, ...]


# --- keys and records ---------------------------------------------------------

def site_key(url: Column) -> Column:
    """The url with its host reversed, without scheme, user and fragment."""
    whole = F.regexp_replace(url, "(?s)#.*$", "")
    rest = F.regexp_extract(whole, "(?s)^.*?://(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), "^.*@", ""))
    name, port = F.regexp_replace(host, ":[0-9]*$", ""), F.regexp_extract(host, ":[0-9]+$", 0)
    turned = F.when(name.rlike(r"^([0-9.]+|\[.*)$"), name).otherwise(F.array_join(F.reverse(F.split(name, r"\.")), ","))
    path = F.regexp_replace(rest, "^[^/?]*", "")
    return F.when(url.isNull(), "").when(whole.contains("://"), F.concat(turned, port, F.lit(")"), path)).otherwise(
        F.concat(F.lit(")"), whole))


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None,
           refers_key: str | None, date: str) -> bytes:
    """One record; a revisit, without the payload, if it refers to another page."""
    head = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Date: {date}",
            f"WARC-Record-ID: <{PAGE}{'none' if page is None else page}>", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if refers is not None:
        # the key as JSON, which has no line breaks
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{PAGE}{refers}>", f"{KEY_HEADER}: {json.dumps(refers_key)}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_header(refers_url)}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:40]}")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return headers, block.partition(b"\r\n\r\n")[2]


def _page_of(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(PAGE)
    return int(number) if number not in ("", "none") else None


# --- files --------------------------------------------------------------------

def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class _Writer:
    """A file of gzip members under a new name."""

    def __init__(self, folder: str, kind: str) -> None:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.{kind}.gz"
        self.out, self.at = system.open_output_stream(f"{base}/{self.name}", compression=None), 0

    def add(self, data: bytes, level: int = 6) -> tuple[int, int]:
        packed = gzip.compress(data, level, mtime=0)
        begin, self.at = self.at, self.at + len(packed)
        self.out.write(packed)
        return begin, len(packed)

    def close(self) -> None:
        self.out.close()


class _Reader:
    """Ranges of the files of a folder; the last file stays open."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = _place(folder)
        self.name, self.file = None, None

    def member(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.base}/{name}")
        self.file.seek(offset)
        return zlib.decompress(self.file.read(length), 31)

    def whole(self, name: str) -> bytes:
        with self.system.open_input_file(f"{self.base}/{name}") as file:
            return gzip.decompress(file.read())


def _lines(rows: list) -> bytes:
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, volume: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded number and bytes."""
    held, weight = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= size or weight >= volume:
            yield made()
            held, weight = [], 0
    if held:
        yield made()


_LONG, _TEXT = pa.int64(), pa.string()
_CAPTURE = pa.schema([("key", _TEXT), ("id", _LONG), ("file", _TEXT), ("offset", _LONG), ("length", _LONG), ("type", _TEXT),
                      ("bytes", _LONG), ("digest", _TEXT)])


# --- writing ------------------------------------------------------------------

def with_roles(pages: DataFrame, *, order: str, url: str, html: str, least: int = LEAST_BYTES) -> DataFrame:
    """``id, url, html, digest, bytes`` and, of a revisit, ``refers`` and ``refers_url``: the response's id and url."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{order}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), payload.alias("html"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(
        F.count("*").alias("n"), F.min("id").alias("first"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("low")).where("n > 1 AND first IS NOT NULL")
    placed = rows.join(first.select("digest", "first", F.col("low.url").alias("first_url")), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return placed.select("id", "url", "digest", "bytes", F.when(again, F.col("first")).alias("refers"),
                         F.when(again, F.col("first_url")).alias("refers_url"),
                         F.when(again, site_key(F.col("first_url"))).alias("refers_key"), site_key(F.col("url")).alias("key"),
                         F.when(again, F.lit("")).otherwise(F.col("html")).alias("html"))


def write(pages: DataFrame, folder: str, *, order: str = "page_id", url: str = "url", html: str = "html",
          least: int = LEAST_BYTES, roll: int = ROLL, lines: int = LINES, parts: int | None = None, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write all pages as records to archives of about ``roll`` bytes at most, and index them in ``parts`` parts."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def captures():
            out = None
            for page, address, digest, size, refers, refers_url, refers_key, key, text in _rows(batches):
                if out is None:
                    out = _Writer(f"{folder}/archive", "warc")
                    out.add(f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:"
                            f"{uuid.uuid4()}>\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                payload = text.encode("utf-8", "surrogatepass") if refers is None else b""
                offset, length = out.add(record(page, address, payload, digest, refers, refers_url, refers_key, date))
                yield key, page, out.name, offset, length, "response" if refers is None else "revisit", size, digest
                if out.at >= roll:
                    out.close()
                    out = None
            if out is not None:
                out.close()

        yield from _batches(captures(), _CAPTURE)

    rows = with_roles(pages, order=order, url=url, html=html, least=least)
    captures = checkpointed(small_batches(rows).mapInArrow(archive, CAPTURE))
    return write_index(captures, folder, lines=lines, parts=parts)


def write_index(captures: DataFrame, folder: str, *, lines: int = LINES, parts: int | None = None) -> Archive:
    """Sort captures into compressed blocks of ``lines`` lines with a directory for each part; Spark sets the
    number of parts if there is none given."""

    part = pa.schema([*list(_CAPTURE)[:4], ("blocks", _TEXT), ("directory", _TEXT)])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory, first = None, [], [], None

        def flush():
            offset, length = out.add(_lines(held))
            directory.append([held[0][0], held[0][1], offset, length])
            held.clear()

        for row in _rows(batches):
            out, first = out or _Writer(f"{folder}/index", "cdx"), first or row
            held.append(row)
            if len(held) >= lines:
                flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        sparse = _Writer(f"{folder}/index", "directory")
        sparse.add(_lines(directory))
        sparse.close()
        yield from _batches(iter([(*first[:4], out.name, sparse.name)]), part)

    order = [F.col("key"), F.col("id").isNull(), F.col("id"), F.col("file"), F.col("offset")]
    dealt = captures.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(index, "key string, id long, file string, offset long, blocks string, directory string").collect()
    made.sort(key=lambda p: (place(p.key, p.id), p.file, p.offset))
    return Archive(folder, tuple(place(p.key, p.id) for p in made), tuple(f"{p.blocks} {p.directory}" for p in made))


# --- searching ----------------------------------------------------------------

def place(key: str, page: int | None) -> tuple:
    """Where a line stands in the index."""
    return key, page is None, page or 0


class Index:
    """Bisection over parts, blocks and lines; the last directory and block stay in memory."""

    def __init__(self, archive: Archive) -> None:
        self.archive, self.files = archive, _Reader(f"{archive.folder}/index")
        self.part, self.directory, self.firsts = None, [], []
        self.block, self.lines, self.places = None, [], []

    def _open_part(self, part: int) -> None:
        if part != self.part:
            name = self.archive.parts[part].split(" ")[1]
            self.directory = [json.loads(x) for x in self.files.whole(name).splitlines()]
            self.part, self.firsts = part, [place(key, page) for key, page, *_ in self.directory]

    def _open_block(self, block: int) -> None:
        if (self.part, block) != self.block:
            _, _, offset, length = self.directory[block]
            data = self.files.member(self.archive.parts[self.part].split(" ")[0], offset, length)
            self.lines = [json.loads(x) for x in data.splitlines()]
            self.block, self.places = (self.part, block), [place(r[0], r[1]) for r in self.lines]

    def blocks_from(self, start: tuple) -> Iterator[tuple[int, int]]:
        """(part, block) of the block that may hold the first line from ``start`` on, and of those after it."""
        for part in range(max(0, bisect_left(self.archive.firsts, start) - 1), len(self.archive.parts)):
            self._open_part(part)
            for block in range(max(0, bisect_left(self.firsts, start) - 1), len(self.directory)):
                self._open_part(part)
                yield part, block

    def lines_from(self, start: tuple) -> Iterator[tuple[tuple, list]]:
        """Lines at ``start`` and after it, each with its place."""
        for part, block in self.blocks_from(start):
            self._open_part(part)
            self._open_block(block)
            places, lines = self.places, self.lines
            for i in range(bisect_left(places, start), len(lines)):
                yield places[i], lines[i]

    def at(self, key: str, page: int | None) -> Iterator[list]:
        """All captures of a page."""
        start = place(key, page)
        for found, line in self.lines_from(start):
            if found != start:
                return
            yield line


def find(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The captures of all ``(key, id)`` of ``wanted``, of which it has each once."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(archive)
        yield from _batches((tuple(line) for key, page in _rows(batches) for line in index.at(key, page)), _CAPTURE)

    order = [F.col("key"), F.col("id").isNull(), F.col("id")]
    return wanted.select("key", "id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(search, CAPTURE)


def of_hosts(archive: Archive, hosts: DataFrame, host: str) -> DataFrame:
    """The captures of all hosts of a column and of their subdomains, whatever their number.

    Bisection gives the blocks of each host first; these are then dealt to tasks one by one.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(archive)

        def rows():
            for (turned,) in _rows(batches):
                for mark in MARKS:
                    for part, block in index.blocks_from((turned + mark,)):
                        if index.firsts[block] >= (turned + chr(ord(mark) + 1),):
                            break
                        yield turned, part, block

        yield from _batches(rows(), pa.schema([("host", _TEXT), ("part", pa.int32()), ("block", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(archive)

        def rows():
            for turned, part, block in _rows(batches):
                index._open_part(part)
                index._open_block(block)
                yield from (tuple(r) for r in index.lines if r[0].startswith(tuple(turned + m for m in MARKS)))

        yield from _batches(rows(), _CAPTURE)

    name = F.array_join(F.reverse(F.split(F.lower(F.col(f"`{host}`")), r"\.")), ",")
    refs = hosts.where(F.col(f"`{host}`").isNotNull()).select(name.alias("host")).distinct().mapInArrow(
        blocks, "host string, part int, block int").distinct()
    return refs.repartition("part", "block").mapInArrow(read, CAPTURE).distinct()


# --- reading ------------------------------------------------------------------

RECORD = "id long, url string, type string, refers long, refers_key string, bytes long, digest string, payload binary"


def read_records(archive: Archive, captures: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of captures, each read by its range. ``bytes`` and ``digest`` are those of the payload that is there;
    a revisit has none of its own and gives the digest it is written with."""
    out = pa.schema([("id", _LONG), ("url", _TEXT), ("type", _TEXT), ("refers", _LONG), ("refers_key", _TEXT), ("bytes", _LONG),
                     ("digest", _TEXT), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Reader(f"{archive.folder}/archive")

        def rows():
            for name, offset, length in _rows(batches):
                headers, payload = parsed(files.member(name, offset, length))
                written = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                own = headers["WARC-Type"] == "response"
                if own and hashlib.sha256(payload).hexdigest() != written:
                    raise ValueError(f"payload and digest differ: {name} at {offset}")
                yield (_page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"],
                       _page_of(headers.get("WARC-Refers-To")), json.loads(headers.get(KEY_HEADER, "null")),
                       len(payload) if own else None, written, payload if own and payloads else None)

        yield from _batches(rows(), out)

    return captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions(
        "file", "offset").mapInArrow(read, RECORD)


def captured(archive: Archive, pages: DataFrame, *, order: str = "page_id", url: str = "url", payloads: bool = True) -> DataFrame:
    """The records of all pages, revisits with the payload of the response they name."""
    wanted = pages.select(F.col(f"`{order}`").cast("long").alias("id"), site_key(F.col(f"`{url}`")).alias("key")).distinct()
    records = checkpointed(read_records(archive, find(archive, wanted), payloads=payloads))
    named = records.where("refers IS NOT NULL").select(
        F.col("refers").alias("id"), F.col("refers_key").alias("key")).distinct()
    there = read_records(archive, find(archive, named), payloads=payloads).where("type = 'response'").select(
        F.col("id").alias("refers"), "digest", F.col("bytes").alias("there_bytes"), F.col("payload").alias("there"))
    there = there.dropDuplicates(["refers", "digest"])
    revisits = records.where("refers IS NOT NULL").drop("bytes", "payload").join(there, ["refers", "digest"], "left")
    columns = ["id", "url", "type", "refers", "bytes", "digest", "payload"]
    return records.where("refers IS NULL").select(*columns).unionByName(
        revisits.withColumnsRenamed({"there_bytes": "bytes", "there": "payload"}).select(*columns))


def new_folder(spark: SparkSession) -> str:
    """A place in the shared folder for an archive."""
    return f"{shared_folder(spark).rstrip('/')}/captures-{uuid.uuid4().hex}"

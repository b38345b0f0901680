"""Binary files: records in ZIPs, pages of documents, attribute tables and outlines in shape archives.

``binaryFile`` lists and ships the files, one task a file; the bytes are read
where the task runs, without unpacking to disk.  Archives too large for that
are read by ``ArchiveMembers``, a data source with a partition for each member.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.schemas import RECORD


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


#: Bytes that are unpacked at once.
CHUNK = 1 << 22


class RecordCutter:
    """Cuts the objects of one top-level array out of JSON text that comes in chunks.

    Nothing is parsed: numpy finds the quotes that open or close a string, and
    brackets outside strings give the depth.  Held are one chunk and the
    record that is not complete yet.  Elements that are no objects are skipped.
    """

    #: Bytes before a bracket in which its key must stand.
    REACH = 1024

    def __init__(self, key: str = "records") -> None:
        self.key = f'"{key}"'.encode()
        self.depth, self.quoted, self.carry, self.tail = 0, 0, b"", b""
        self.parts: list[bytes] | None = None
        self.state = "before"

    def cut(self, chunk: bytes) -> list[bytes]:
        """The records that end in ``chunk``."""
        if self.state == "after":
            return []
        chunk = self.carry + chunk
        whole = len(chunk.rstrip(b"\\"))  # a backslash at the end waits for what it escapes
        chunk, self.carry = chunk[:whole], chunk[whole:]
        raw = np.frombuffer(chunk, dtype=np.uint8)
        quotes = np.flatnonzero(raw == 0x22)
        slashes = np.flatnonzero(raw == 0x5C)
        if len(slashes):
            last = np.flatnonzero(np.concatenate([np.diff(slashes) != 1, [True]]))
            odd = np.diff(np.concatenate([[-1], last])) % 2 == 1
            escaped = np.zeros(len(raw) + 1, dtype=bool)
            escaped[slashes[last[odd]] + 1] = True
            quotes = quotes[~escaped[quotes]]
        brackets = np.flatnonzero((raw | 0x20 == 0x7B) | (raw | 0x20 == 0x7D))
        brackets = brackets[(np.searchsorted(quotes, brackets) + self.quoted) % 2 == 0]
        opens = raw[brackets] & 0x06 == 0x02
        depth = self.depth + np.cumsum(np.where(opens, 1, -1))
        self.quoted = (self.quoted + len(quotes)) % 2
        outer = np.flatnonzero((depth == 2) | (depth == 3) & opens | (depth == 1) & ~opens)
        records, start = self._walk(chunk, zip(brackets[outer].tolist(), depth[outer].tolist(), opens[outer].tolist(), strict=True))
        if self.parts is not None:
            self.parts.append(chunk[start:])
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.tail = (self.tail + chunk)[-self.REACH :]
        return records

    def _walk(self, chunk: bytes, brackets: Iterator[tuple[int, int, bool]]) -> tuple[list[bytes], int]:
        records, start = [], 0
        for at, depth, opens in brackets:
            if self.state == "before":
                if depth == 2 and opens and chunk[at : at + 1] == b"[":
                    ahead = (self.tail + chunk[:at] if at < self.REACH else chunk[at - self.REACH : at]).rstrip()
                    if ahead.endswith(b":") and ahead[:-1].rstrip().endswith(self.key):
                        self.state = "inside"
            elif depth == 3:
                if chunk[at : at + 1] == b"{":
                    self.parts, start = [], at
            elif depth == 2 and self.parts is not None:
                records.append(b"".join([*self.parts, chunk[start : at + 1]]))
                self.parts = None
            elif depth == 1:
                self.state = "after"
                break
        return records, start

    def finish(self, name: str) -> None:
        if self.state != "after":
            raise ValueError(f"{name}: " + ("the text ends inside its records" if self.state == "inside" else f"no array {self.key.decode()}"))


def cut_records(stream: IO[bytes], name: str, key: str = "records") -> Iterator[list[bytes]]:
    """The records of a stream of JSON text, chunk by chunk; a text without the array is an error."""
    cutter = RecordCutter(key)
    while chunk := stream.read(CHUNK):
        if found := cutter.cut(chunk):
            yield found
    cutter.finish(name)


def zipped_records(files: DataFrame, key: str = "records") -> DataFrame:
    """(path, record): every record of the one JSON package inside each ZIP of ``read_binary``."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive, archive.open(archive.namelist()[0]) as member:
                    for records in cut_records(member, path, key):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(records)), pa.array(records, pa.binary()).cast(pa.string())], names=["path", "json"])

    text = files.select("path", "content").mapInArrow(unpack, "path string, json string")
    return text.select("path", F.from_json("json", RECORD).alias("record")).select("path", "record.*")


@dataclass
class Member(InputPartition):
    """One member of one archive."""

    archive: str
    name: str


class ArchiveMembers(DataSource):
    """Records of JSON members of the ZIPs below ``path``: (path, member, json), a partition for each member.

    Central directories are read once, on the driver; members are unpacked as
    streams, so their size does not matter.  Options: ``path`` (a folder or a
    file, of any file system that Arrow opens), ``archives`` and ``members``
    (patterns, ``*.zip`` and ``*.json``), ``key`` (``records``).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "path string, member string, json string"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(dict(self.options))


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def _open(self, path: str):
        from pyarrow import fs

        files, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return files, where

    def partitions(self) -> list[Member]:
        from pyarrow import fs

        files, where = self._open(self.options["path"])
        info = files.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.type == fs.FileType.File else [i for i in files.get_file_info(fs.FileSelector(where, recursive=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.options.get("archives", "*.zip"))]
        out = []
        for i in sorted(found, key=lambda i: i.path):
            with files.open_input_file(i.path) as raw, zipfile.ZipFile(raw) as archive:
                out += [Member(i.path, n) for n in archive.namelist() if fnmatch.fnmatch(n, self.options.get("members", "*.json"))]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        files, _ = self._open(self.options["path"])
        with files.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.name) as member:
            for records in cut_records(member, f"{partition.archive}!{partition.name}", self.options.get("key", "records")):
                n = len(records)
                yield pa.RecordBatch.from_arrays([pa.array([partition.archive] * n), pa.array([partition.name] * n), pa.array(records, pa.binary()).cast(pa.string())], names=["path", "member", "json"])


def member_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, member, record): as ``zipped_records``, for archives with members of any size and number."""
    spark.dataSource.register(ArchiveMembers)
    text = spark.read.format("archive_members").options(path=path, **options).load()
    return text.select("path", "member", F.from_json("json", RECORD).alias("record")).select("path", "member", "record.*")


def inner_digest(files: DataFrame) -> DataFrame:
    """(path, sha256): of the document inside each ZIP, which is what publishers sign."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sums = []
            for content in batch.column(1):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive, archive.open(archive.namelist()[0]) as member:
                    sums.append(hashlib.file_digest(member, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], names=["path", "sha256"])

    return files.select("path", "content").mapInArrow(digest, "path string, sha256 string")


def document_pages(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(document, page, text, chars): a row per page, numbered from 1 as in the original.

    ``extract`` gives a document's page texts; by default PyMuPDF or pypdf,
    whichever is installed.
    """
    from lodestar.schemas import PAGE

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = extract or _pdf_reader()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                texts = read(content)
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame({"document": name, "page": range(1, len(texts) + 1), "text": texts, "chars": [len(t) for t in texts]})

    return files.select("path", "content").mapInPandas(pages, PAGE)


def _pdf_reader() -> Callable[[bytes], list[str]]:
    try:
        import fitz

        return lambda content: [page.get_text() for page in fitz.open(stream=content, filetype="pdf")]
    except ModuleNotFoundError:
        import pypdf

        return lambda content: [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def _attributes(content: bytes) -> list[dict[str, str]]:
    """Rows of a dBase table: text of every field, deleted rows left out."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    columns, at, offset = [], 32, 1
    while content[at] != 0x0D:
        columns.append((content[at : at + 11].split(b"\0")[0].decode(), offset, content[at + 16]))
        offset += content[at + 16]
        at += 32
    rows = (content[head + i * size : head + (i + 1) * size] for i in range(n))
    return [{name: row[o : o + w].decode("utf-8", "replace").strip() for name, o, w in columns} for row in rows if row[:1] != b"*"]


def _outlines(content: bytes) -> list[list[list[list[list[float]]]]]:
    """Polygons of every shape: outer rings (clockwise) each with the holes that follow it."""
    shapes, at = [], 100
    while at + 8 <= len(content):
        (words,) = struct.unpack_from(">I", content, at + 4)
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        polygons: list = []
        if struct.unpack_from("<I", body)[0] in (5, 15, 25):
            n_parts, n_points = struct.unpack_from("<II", body, 36)
            starts = [*struct.unpack_from(f"<{n_parts}I", body, 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", body, 44 + 4 * n_parts)
            points = [list(p) for p in zip(flat[0::2], flat[1::2], strict=True)]
            for first, last in zip(starts, starts[1:], strict=False):
                ring = points[first:last]
                area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
                if area <= 0 or not polygons:
                    polygons.append([ring])
                else:
                    polygons[-1].append(ring)
        shapes.append(polygons)
    return shapes


def shape_archive(files: DataFrame, base: str, fields: list[str], outlines: bool = False) -> DataFrame:
    """Attribute columns (and ``polygons``) of the shapes ``base`` inside each ZIP."""
    schema = ", ".join(f"{f} string" for f in fields) + (", polygons array<array<array<array<double>>>>" if outlines else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    out = pd.DataFrame(_attributes(archive.read(f"{base}.dbf")), columns=fields)
                    if outlines:
                        out["polygons"] = _outlines(archive.read(f"{base}.shp"))
                yield out

    return files.select("path", "content").mapInPandas(read, schema)


def territory(districts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(departments, provinces, districts named in one department only), each (key, department)."""
    from lodestar.functions.text import accent_key

    keyed = districts.select("department", accent_key(F.col("department")).alias("d"), accent_key(F.col("province")).alias("p"), accent_key(F.col("district")).alias("t"))
    pairs = lambda key: keyed.groupBy(F.col(key).alias("key")).agg(F.min("department").alias("department"), F.count_distinct("department").alias("n"))
    return pairs("d").drop("n"), pairs("p").drop("n"), pairs("t").filter("n = 1").drop("n")

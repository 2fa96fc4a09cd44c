"""Archives (zip, tar, tgz) as a table of their members, in a batch or as a stream: a task some archives of one folder, a member at a time."""

from __future__ import annotations

import hashlib
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sinks.staged import file_system
from .files import ARCHIVE, UNREADABLE, is_safe_member

SCHEMA = "archive string, member string, size long, sha256 string, content binary, problem string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
#: Larger members have their size and digest, but not their content.
MOST_CONTENT = 64 << 20
#: Bytes that are read at a time, and bytes of contents that are handed on together.
PIECE, BATCH = 1 << 20, 4 << 20
FAILS = (*UNREADABLE, tarfile.TarError)


#: Archives, and bytes of them, that a task reads at most, unless one alone is larger.
MOST_ARCHIVES, MOST_BYTES = 1000, 128 << 20


@dataclass
class SomeArchives(InputPartition):
    """Archives of one folder."""

    folder: str
    names: tuple[str, ...]


def dealt(found: list[tuple[int, str, int]]) -> list[SomeArchives]:
    """(time, path, size) of archives -> partitions of some each, so that neither tasks nor what the driver holds for them grow with the number of small archives, but for their names."""
    out, held, at, size = [], [], "", 0
    for _, path, n in sorted(found, key=lambda f: f[1]):
        folder, name = path[: path.rindex("/") + 1] if "/" in path else "", path.rsplit("/", 1)[-1]
        if held and (folder != at or len(held) >= MOST_ARCHIVES or size + n > MOST_BYTES):
            out.append(SomeArchives(at, tuple(held)))
            held, size = [], 0
        held.append(name)
        at, size = folder, size + n
    return [*out, SomeArchives(at, tuple(held))] if held else out


def read_dealt(partition: SomeArchives, most: int) -> Iterator[pa.RecordBatch]:
    yield from batches(row for name in partition.names for row in members(partition.folder + name, most))


def archives_below(path: str) -> list[tuple[int, str, int]]:
    """(time, path, size) of the archives below a folder, or of the one that path names, sorted. The driver holds their names."""
    system, at = file_system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((f.mtime_ns or 0, f"{scheme}{f.path}", f.size or 0) for f in found if f.type == fs.FileType.File and re.search(ARCHIVE, f.path) and "/_staging-" not in f.path)


def _zip_members(z: zipfile.ZipFile) -> Iterator[tuple[str, bool, bool, Callable]]:
    for i in z.infolist():
        if not i.is_dir():
            yield i.filename, i.external_attr >> 16 & 0o170000 != 0o120000, bool(i.flag_bits & 1), lambda i=i: z.open(i)


def _tar_members(t: tarfile.TarFile) -> Iterator[tuple[str, bool, bool, Callable]]:
    for i in t:
        if not i.isdir():
            yield i.name, i.isreg(), False, lambda i=i: t.extractfile(i)
        t.members = []  # type: ignore[attr-defined]  # what has been passed is not kept


def _content(stream, most: int) -> tuple[int, str, bytes | None]:
    """(size, digest, content if it is not too large), read in pieces."""
    size, sha, kept = 0, hashlib.sha256(), bytearray()
    while piece := stream.read(PIECE):
        size += len(piece)
        sha.update(piece)
        if size <= most:
            kept += piece
        else:
            kept = bytearray()
    return size, sha.hexdigest(), bytes(kept) if size <= most else None


def members(path: str, most: int = MOST_CONTENT) -> Iterator[tuple]:
    """(archive, member, size, sha256, content, problem) of one archive, a member at a time: no more is held than one content of `most` bytes.

    An archive with a member that is no plain file, or whose name leads out of it, gives that problem and nothing else; names are looked through before anything is read. A member that is
    encrypted, broken, of unknown compression or larger than `most` bytes is a row with a problem; others go on, but a tar ends where it is broken. An archive that cannot be opened is one row.
    """
    system, at = file_system(path)
    zipped = path.lower().endswith(".zip")

    def opened(f):
        return zipfile.ZipFile(f) if zipped else tarfile.open(fileobj=f, mode="r|*")  # noqa: SIM115

    try:
        with system.open_input_file(at) as f, opened(f) as z:
            for name, plain, _, _ in (_zip_members if zipped else _tar_members)(z):
                if not plain or not is_safe_member(name):
                    yield path, name, None, None, None, "unsafe member"
                    return
    except FAILS as e:
        if zipped:
            yield path, None, None, None, None, f"unreadable: {type(e).__name__}"
            return
    try:
        with system.open_input_file(at) as f, opened(f) as z:
            for name, _, secret, content in (_zip_members if zipped else _tar_members)(z):
                name = name.replace("\\", "/")
                if secret:
                    yield path, name, None, None, None, "encrypted"
                    continue
                try:
                    with content() as stream:
                        size, sha, kept = _content(stream, most)
                    yield path, name, size, sha, kept, None if kept is not None else f"larger than {most} bytes"
                except FAILS as e:
                    yield path, name, None, None, None, f"unreadable: {type(e).__name__}"
                    if not zipped:
                        return
    except FAILS as e:
        yield path, None, None, None, None, f"unreadable: {type(e).__name__}"


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH bytes of content, or one row."""
    held, size = [], 0
    for r in rows:
        if held and size + len(r[4] or b"") > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
            held, size = [], 0
        held.append(r)
        size += len(r[4] or b"") + 200
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self):
        return dealt(archives_below(self.path)) or [SomeArchives("", ())]

    def read(self, partition):
        yield from read_dealt(partition, self.most)


class ArchiveStream(DataSourceStreamReader):
    """New archives as they come. An offset is the time and name of the last archive; one that arrives with an older time than that is not seen, as with Spark's own file streams of old files."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        found = archives_below(self.path)
        return {"time": str(found[-1][0]), "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = ((int(o["time"]), o["path"]) for o in (start, end))
        return dealt([f for f in archives_below(self.path) if low < f[:2] <= high])

    def read(self, partition):
        yield from read_dealt(partition, self.most)


class Archives(DataSource):
    """spark.read.format("archives").load(path), and the same with readStream. Option mostContent: bytes up to which contents are kept."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("mostContent", MOST_CONTENT))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(*self._args())

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(*self._args())


def read_archives(spark: SparkSession, path: str, most: int = MOST_CONTENT) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("archives").option("mostContent", most).load(path)


def stream_archives(spark: SparkSession, path: str, most: int = MOST_CONTENT) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.readStream.format("archives").option("mostContent", most).load(path)

"""Writing files in one step: tasks write to a staged folder, and what they wrote appears when the whole job has succeeded, or not at all."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging-"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) or of a plain local path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def names_below(system: fs.FileSystem, at: str) -> list[str]:
    """Names right below a folder; none if it does not exist."""
    return [f.base_name for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True))]


@dataclass
class Wrote(WriterCommitMessage):
    """What a task left: the folder it wrote to, with how many files of how many bytes."""

    folder: str
    files: int
    size: int


class StagedWriter(DataSourceWriter):
    """A writer whose tasks make any number of files, each in a folder of the task's own below <path>/_staging-<job>/.

    commit: the folders of the tasks that Spark counts as done are moved to <path>/part-<task>-<job>, one rename a task, so neither the driver's work nor what is sent to it
    grows with the number of files; with overwrite, earlier parts go after the new ones are there. What lost or repeated tasks left is deleted with the staging folder, as is all of it on abort.
    A task that fails deletes its own folder. Subclasses turn rows into files: see files().
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def files(self, rows: Iterator) -> Iterator[tuple[str, object]]:
        """(name, function that writes to a stream) for each file. A name is made safe as a file's."""
        raise NotImplementedError

    @property
    def staging(self) -> str:
        return f"{self.path}/{STAGING}{self.job}"

    def write(self, iterator: Iterator) -> Wrote:
        system, at = file_system(f"{self.staging}/{uuid.uuid4().hex}")
        system.create_dir(at, recursive=True)
        n = size = 0
        try:
            for name, fill in self.files(iterator):
                with system.open_output_stream(f"{at}/{quote(name, safe=' .-_()')}") as out:
                    fill(out)
                    size += out.tell()
                n += 1
        except BaseException:
            with contextlib.suppress(OSError):
                system.delete_dir(at)
            raise
        return Wrote(at.rsplit("/", 1)[1], n, size)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, at = file_system(self.path)
        old = [n for n in names_below(system, at) if n.startswith("part-")]
        for k, m in enumerate(m for m in messages if m is not None and m.files):
            system.move(f"{at}/{STAGING}{self.job}/{m.folder}", f"{at}/part-{k:05d}-{self.job}")
        if self.overwrite:
            for name in old:
                system.delete_dir(f"{at}/{name}")
        self._clear(system, at)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, system: fs.FileSystem, at: str) -> None:
        if f"{STAGING}{self.job}" in names_below(system, at):
            system.delete_dir(f"{at}/{STAGING}{self.job}")


class FileWriter(StagedWriter):
    """Rows of (name, content): each a file as it is."""

    def files(self, rows):
        for r in rows:
            yield r["name"], lambda out, r=r: out.write(bytes(r["content"]))


class BinaryFiles(DataSource):
    """df.write.format("binary_files").save(path) of rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"name", "content"} <= set(schema.fieldNames()):
            raise ValueError("binary_files takes rows of (name, content)")
        return FileWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """files(name, content) below path, all or none."""
    files.sparkSession.dataSource.register(BinaryFiles)
    files.select("name", "content").write.format("binary_files").mode(mode).save(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet below path/<name>, in the place of those that were there: all are written to a staged folder first, and put in place when the last one is there. If one fails, what was there stays."""
    system, at = file_system(path.rstrip("/"))
    staged = f"{STAGING}{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{path.rstrip('/')}/{staged}/{name}")
        have = set(names_below(system, at))
        for name in tables:
            if name in have:
                system.move(f"{at}/{name}", f"{at}/{staged}/old-{name}")
            system.move(f"{at}/{staged}/{name}", f"{at}/{name}")
    finally:
        if staged in names_below(system, at):
            system.delete_dir(f"{at}/{staged}")


def delivered(files: DataFrame, wanted: tuple[str, ...], must: str) -> tuple[DataFrame, DataFrame]:
    """(files to deliver, runs without the file they must have). files(run_id, name, content); wanted: names in a delivery; those that a run lacks are left out."""
    mine = files.where(files["name"].isin(*wanted))
    runs = files.select("run_id").distinct()
    return mine, runs.join(files.where(files["name"] == must).select("run_id"), "run_id", "left_anti")



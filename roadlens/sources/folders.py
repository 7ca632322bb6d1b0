"""A writer of folders with copied files: all of them are replaced when the job commits, none where it fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..storage import ensure_checkpoint_dir

#: Bytes of a file that a task holds at once, rows of a status file's group, and renames that run side by side.
CHUNK, GROUP, SIDE_BY_SIDE = 4 << 20, 20_000, 16
STATUS = "source_path string, target string, status string"
_STATUS = pa.schema([("source_path", pa.string()), ("target", pa.string()), ("status", pa.string())])


def _is(fs: pafs.FileSystem, path: str, kind: pafs.FileType) -> bool:
    return fs.get_file_info(path).type == kind


def _drop(fs: pafs.FileSystem, folder: str) -> None:
    if _is(fs, folder, pafs.FileType.Directory):
        fs.delete_dir(folder)


def _move(fs: pafs.FileSystem, old: str, new: str) -> None:
    """Renames a folder; file by file where the file system has no renames of folders."""
    fs.create_dir(new.rsplit("/", 1)[0], recursive=True)
    try:
        fs.move(old, new)
    except NotImplementedError:
        for f in fs.get_file_info(pafs.FileSelector(old, recursive=True)):
            if f.type == pafs.FileType.File:
                to = new + f.path[len(old) :]
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                fs.move(f.path, to)
        fs.delete_dir(old)


def _inside(folder: str, target: str | None) -> None:
    if folder in ("", ".", "..") or "/" in folder or "\\" in folder:
        raise ValueError(f"not a folder below the base: {folder!r}")
    if target is not None and (not target.startswith(folder + "/") or {"", ".", ".."} & set(target.split("/"))):
        raise ValueError(f"not a file of folder {folder!r}: {target!r}")


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    folders: list[str]


class _Writer(DataSourceWriter):
    """Each task attempt copies into a folder of its own below ``base``/_staging-<job>; the commit renames whole folders from there."""

    def __init__(self, base: str, status: str, strict: bool):
        self.base, self.status, self.strict = base.rstrip("/"), status, strict
        self.job = uuid.uuid4().hex

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        fs, base = pafs.FileSystem.from_uri(self.base)
        return fs, base, f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        fs, _, staging = self._places()
        side, status = pafs.FileSystem.from_uri(self.status)
        side.create_dir(status, recursive=True)
        attempt = uuid.uuid4().hex
        folders: dict[str, None] = {}
        done: list[tuple] = []
        last = None
        with pq.ParquetWriter(f"{status}/{attempt}.parquet", _STATUS, filesystem=side) as out:

            def flush():
                out.write_table(pa.table(list(zip(*done, strict=True)) or [[], [], []], schema=_STATUS))
                done.clear()

            for row in iterator:
                _inside(row.folder, row.target)
                folders[row.folder] = None
                if row.target is None or (row.source_path, row.target) == last:
                    continue
                last = (row.source_path, row.target)
                done.append((*last, "copied" if self._copied(fs, row.source_path, f"{staging}/{attempt}/{row.target}") else "missing"))
                if len(done) == GROUP:
                    flush()
            flush()
        return _Written(attempt, list(folders))

    def _copied(self, fs: pafs.FileSystem, source: str | None, target: str) -> bool:
        there, path = pafs.FileSystem.from_uri(source) if source and (source[0] == "/" or ":" in source) else (None, None)
        if there is None or not _is(there, path, pafs.FileType.File):
            if self.strict:
                raise FileNotFoundError(source)
            return False
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with there.open_input_stream(path) as a, fs.open_output_stream(target) as b:
            while part := a.read(CHUNK):
                b.write(part)
        return True

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base, staging = self._places()
        whole = [m for m in messages if m is not None]
        pairs = [(m.attempt, f) for m in whole for f in m.folders]
        if len({f for _, f in pairs}) < len(pairs):
            raise ValueError("rows of one folder came to several tasks")

        def replace(pair: tuple[str, str]) -> None:
            attempt, folder = pair
            if _is(fs, f"{base}/{folder}", pafs.FileType.Directory):
                _move(fs, f"{base}/{folder}", f"{staging}/replaced/{folder}")
            if _is(fs, f"{staging}/{attempt}/{folder}", pafs.FileType.Directory):
                _move(fs, f"{staging}/{attempt}/{folder}", f"{base}/{folder}")

        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            list(pool.map(replace, pairs))
        _drop(fs, staging)
        # attempts that were repeated left a status too
        side, status = pafs.FileSystem.from_uri(self.status)
        valid = {f"{m.attempt}.parquet" for m in whole}
        for f in side.get_file_info(pafs.FileSelector(status, allow_not_found=True)):
            if f.base_name not in valid:
                side.delete_file(f.path)

    def abort(self, messages: list[_Written | None]) -> None:
        """Folders that a commit which failed half way had taken out, with none in their place yet, come back."""
        fs, base, staging = self._places()
        for f in fs.get_file_info(pafs.FileSelector(f"{staging}/replaced", allow_not_found=True)):
            if not _is(fs, f"{base}/{f.base_name}", pafs.FileType.Directory):
                _move(fs, f.path, f"{base}/{f.base_name}")
        _drop(fs, staging)


class FolderCopies(DataSource):
    """``df.write.format("folder_copies")`` for rows (folder, source_path, target): see ``copy_folders``."""

    @classmethod
    def name(cls) -> str:
        return "folder_copies"

    def schema(self) -> str:
        return "folder string, source_path string, target string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["base"], self.options["status"], json.loads(self.options.get("strict", "false")))


def copy_folders(rows: DataFrame, base: str, strict: bool = False) -> DataFrame:
    """Replaces folders below ``base`` by the copies that ``rows`` (folder, source_path, target) name; returns (source_path, target, status): copied or missing.

    A folder is one name, a target a path below it. A row with a null target only names its folder,
    which goes if no file is copied into it. ``strict`` makes a missing source an error.
    Files are copied by tasks into a staging folder below ``base``, and only when all have succeeded are
    the folders put in place, by a rename each: a failed job leaves ``base`` as it was, and neither a lost executor nor a
    task that runs twice leaves a part of a folder. ``base`` and sources are paths or URIs of any file system that pyarrow reaches from
    the workers; on one without renames of folders the files are moved one by one. Of rows with one target the
    greatest source path stays. A folder's rows are one task's work; an empty table changes nothing.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    spark.dataSource.register(FolderCopies)
    status = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    dealt = rows.select("folder", "source_path", "target").repartition("folder").sortWithinPartitions("folder", "target", "source_path")
    dealt.write.format("folder_copies").mode("append").option("base", base).option("status", status).option("strict", json.dumps(strict)).save()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(status)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], STATUS)
    return spark.read.schema(STATUS).parquet(status)

"""Data sources of small files: the beginnings of a folder's files, files under names of their own, and
files under names of their own that lie in tar volumes.

All go through the file systems that Arrow knows (local, HDFS, S3 and others by their URI), so they
see what Spark's readers see.
"""

import io
import posixpath
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEAD_BYTES = 1024
_STAGED = "_staged-"
_AT_ONCE = 16
VOLUME = ".tar.zst"
#: Files of a volume: one is unpacked in memory.
_MEMBERS = 20_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class _Files(InputPartition):
    found: list[tuple[str, int]]


class _HeadReader(DataSourceReader):
    def __init__(self, path: str, per_task: int, n_bytes: int) -> None:
        self.path, self.per_task, self.n_bytes = path, per_task, n_bytes

    def partitions(self) -> list[InputPartition]:
        system, folder = _opened(self.path)
        infos = system.get_file_info(fs.FileSelector(folder, recursive=True))
        found = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and not any(p.startswith((_STAGED, ".")) for p in i.path[len(folder) :].split("/")))
        return [_Files(found[at : at + self.per_task]) for at in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)

        def head(file: tuple[str, int]) -> tuple:
            path, size = file
            with system.open_input_file(path) as opened:
                return path, size, opened.read(self.n_bytes or None)

        with ThreadPoolExecutor(_AT_ONCE) as pool:
            yield from pool.map(head, partition.found)


class FileHeads(DataSource):
    """(path, length, head) of all files below a folder, but for hidden ones: of each file its first 1024
    bytes are read, and no more. Options: path; perTask, the files of one task; bytes, how much of a
    file is read, 0 for all of it."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        given = {k.lower(): v for k, v in self.options.items()}
        return _HeadReader(given["path"], int(given.get("pertask", 1000)), int(given.get("bytes", HEAD_BYTES)))


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    staged: str


class _NamedWriter(DataSourceWriter):
    """Each task writes below a staging folder of its own; commit moves the files of the tasks that
    counted, and abort removes all that was staged."""

    def __init__(self, path: str) -> None:
        self.path, self.job = path, f"{_STAGED}{uuid.uuid4().hex}"
        system, folder = _opened(path)
        system.create_dir(f"{folder}/{self.job}", recursive=True)  # tasks that abort has overtaken find it gone

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, folder = _opened(self.path)
        staged, names = f"{folder}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(staged, recursive=False)
        for row in iterator:
            name = posixpath.basename(row[0])
            with system.open_output_stream(f"{staged}/{name}") as out:
                out.write(bytes(row[1]))
            names.append(name)
        return _Written(names, staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _opened(self.path)
        moves = [(f"{m.staged}/{n}", f"{folder}/{n}") for m in messages if m is not None for n in m.names]
        with ThreadPoolExecutor(_AT_ONCE) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
        self._clear(system, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.job}")


class NamedFiles(DataSource):
    """Writes rows (name: string, content: binary) as files of these names in a folder, whole or not at
    all. Names are to differ."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _NamedWriter(self.options["path"])


_BLOCK = tarfile.BLOCKSIZE
_PLAIN = tarfile.TarInfo("").tobuf(tarfile.PAX_FORMAT)


def _header(name: str, size: int) -> bytes:
    """The tar header of a file; that of a short plain name is the empty header with name, size and sum."""
    short = name.encode()
    if len(short) > 100 or not name.isascii() or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT)
    block = b"%s%s%011o%s        %s" % (short.ljust(100, b"\0"), _PLAIN[100:124], size, _PLAIN[135:148], _PLAIN[156:])
    return b"%s%06o\0%s" % (block[:148], sum(block), block[155:])


def _members(whole: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the files of a volume, given what it unpacks to."""
    with tarfile.open(fileobj=io.BytesIO(whole), mode="r:") as volume:
        for info in volume:
            yield info.name, whole[info.offset_data : info.offset_data + info.size]


class _PackedWriter(_NamedWriter, DataSourceArrowWriter):
    """As _NamedWriter, but what is staged and moved are volumes, so no file's name passes the driver."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = _opened(self.path)
        staged, names = f"{folder}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(staged, recursive=False)
        for batch in _cut(iterator, _MEMBERS):
            names.append(f"{uuid.uuid4().hex}{VOLUME}")
            with system.open_output_stream(f"{staged}/{names[-1]}", compression="zstd") as volume:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    volume.write(b"%s%s%s" % (_header(posixpath.basename(name), len(content)), content, bytes(-len(content) % _BLOCK)))
                volume.write(bytes(2 * _BLOCK))
        return _Written(names, staged)


def _cut(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of ``n`` rows, and the rest."""
    held, count = [], 0
    for batch in batches:
        while count + batch.num_rows >= n:
            yield pa.Table.from_batches([*held, batch.slice(0, n - count)])
            batch, held, count = batch.slice(n - count), [], 0
        held, count = [*held, batch], count + batch.num_rows
    if count:
        yield pa.Table.from_batches(held)


class _PackedReader(_HeadReader):
    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        kind = pa.schema([("name", pa.string()), ("content", pa.binary())])
        for path, _ in partition.found:
            with system.open_input_stream(path, compression="zstd") as volume:
                found = list(_members(volume.read()))
            for at in range(0, len(found), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*found[at : at + 5000]), kind.types)], schema=kind)


class PackedFiles(DataSource):
    """Rows (name: string, content: binary) as files of these names in tar volumes of a folder, whole or
    not at all: for so many small files that each one's block of disk is too much. Names are to differ."""

    @classmethod
    def name(cls) -> str:
        return "packed_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PackedReader(self.options["path"], 1, 0)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PackedWriter(self.options["path"])


def _known(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers ``source``. Formats are looked up in the thread's active session, which a thread that did
    not make the session may lack; createDataFrame makes ``spark`` that."""
    spark.createDataFrame([], "none int")
    spark.dataSource.register(source)


def file_heads(spark: SparkSession, folder: str, per_task: int = 1000, n_bytes: int = HEAD_BYTES) -> DataFrame:
    _known(spark, FileHeads)
    return spark.read.format("file_heads").option("perTask", per_task).option("bytes", n_bytes).load(folder)


def write_named(files: DataFrame, folder: str, packed: bool = False) -> None:
    """``files`` (name, content) as files of a folder, or ``packed`` in tar volumes there."""
    source = PackedFiles if packed else NamedFiles
    _known(files.sparkSession, source)
    files.select("name", "content").write.format(source.name()).mode("append").save(folder)


def packed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files in a folder's tar volumes."""
    _known(spark, PackedFiles)
    return spark.read.format("packed_files").load(folder)

"""Lines of the members of .zip and .tar archives, as a data source whose partitions are members.

Only directories are read to plan: a zip's central directory, a tar's headers. Members that lie uncompressed in their
archive are cut into stretches of ``stretch`` bytes, so one large member takes many tasks; small members are read together,
up to as many bytes a task. A compressed member goes to one task and a compressed tar with all it holds, both streamed:
memory is bounded by blocks and the longest line, and archives may be of any size.
"""

from __future__ import annotations

import fnmatch
import io
import tarfile
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STRETCH = 128 << 20
BLOCK = 1 << 20
BATCH_LINES = 20_000
NAME = "archive_lines"


@dataclass(frozen=True)
class Part:
    """The lines that begin in [start, stop) of a member whose bytes are [begin, end) of the archive, or, without a stretch,
    a whole member (all members of the wanted name in a compressed tar)."""

    archive: str
    member: str | None
    size: int
    begin: int = 0
    end: int = 0
    start: int | None = None

    @property
    def stop(self) -> int:
        return self.start + self.size


@dataclass
class Task(InputPartition):
    parts: list[Part]


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


class _File(io.RawIOBase):
    """A file of pyarrow whose bad positions are the errors that readers of archives look for."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.f.readinto(buffer)

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.f.seek(at, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def close(self) -> None:
        self.f.close()
        super().close()


def _open(path: str) -> io.BufferedReader:
    where, inner = located(path)
    return io.BufferedReader(_File(where.open_input_file(inner)))


def _found(path: str) -> list[str]:
    """The archives a path means: a file, a folder's files, or a pattern in its last part."""
    where, inner = located(path)
    head, _, last = inner.rpartition("/")
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if any(c in last for c in "*?["):
        infos = [i for i in where.get_file_info(fs.FileSelector(head)) if fnmatch.fnmatch(i.base_name, last)]
    else:
        info = where.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(inner))
    return sorted(prefix + i.path for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


def _preferred(names: Iterable[str]) -> str | None:
    """A zip's human member, text before others; without one a text member, then any; the first by name of each."""
    names = sorted(n for n in names if not n.endswith("/"))
    is_text = lambda n: n.lower().endswith((".txt", ".tsv", ".csv", ".tab"))
    is_human = lambda n: "homo_sapiens" in n.lower() or "9606" in n
    return min(names, key=lambda n: (not is_human(n), not is_text(n), n), default=None)


def _stretches(archive: str, member: str, begin: int, size: int, stretch: int) -> list[Part]:
    end = begin + size
    return [Part(archive, member, min(stretch, end - at), begin, end, at) for at in range(begin, end, stretch)]


def _zip_parts(archive: str, name: str | None, stretch: int) -> list[Part]:
    with _open(archive) as f, zipfile.ZipFile(f) as z:
        wanted = [i for i in z.infolist() if not i.is_dir() and i.filename.rsplit("/", 1)[-1] == name] if name else [z.getinfo(n) for n in [_preferred(z.namelist())] if n]
        out: list[Part] = []
        for i in wanted:
            if i.compress_type == zipfile.ZIP_STORED and not i.flag_bits & 1:
                f.seek(i.header_offset + 26)
                lengths = f.read(4)  # of the name and the extra field that stand before the member's bytes
                begin = i.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
                out += _stretches(archive, i.filename, begin, i.file_size, stretch)
            else:
                out.append(Part(archive, i.filename, i.compress_size))
        return out


def _tar_parts(archive: str, name: str | None, stretch: int) -> list[Part]:
    with _open(archive) as f:
        whole = [Part(archive, name, f.seek(0, io.SEEK_END))]
        f.seek(0)
        try:
            t = tarfile.open(fileobj=f, mode="r:")
        except tarfile.ReadError:  # compressed, or no archive, which the task that reads it will say
            return whole
        wanted = [m for m in t if m.isfile() and (not name or m.name.rsplit("/", 1)[-1] == name)]
        if any(m.issparse() for m in wanted):
            return whole
        return [p for m in wanted for p in _stretches(archive, m.name, m.offset_data, m.size, stretch)]


def _blocks(f, left: int | None = None) -> Iterator[bytes]:
    while left is None or left > 0:
        block = f.read(BLOCK if left is None else min(BLOCK, left))
        if not block:
            return
        left = None if left is None else left - len(block)
        yield block


def _lines(blocks: Iterable[bytes], at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its line feed)."""
    held: list[bytes] = []  # a line that goes on over blocks
    for block in blocks:
        *full, rest = block.split(b"\n")
        for line in full:
            line = b"".join([*held, line])
            held.clear()
            yield at, line
            at += len(line) + 1
        if rest:
            held.append(rest)
    if held:
        yield at, b"".join(held)


def _texts(lines: Iterable[bytes]) -> Iterator[str]:
    """Carriage returns end lines too, alone or before the line feed."""
    for line in lines:
        yield from line.removesuffix(b"\r").decode("utf-8", "ignore").split("\r")


def _stretch_lines(f, part: Part) -> Iterator[bytes]:
    inside = part.start > part.begin
    at = part.start - inside  # a byte early, to see whether a line begins right here
    f.seek(at)
    lines = _lines(_blocks(f, part.end - at), at)
    if inside:
        next(lines, None)
    for offset, line in lines:
        if offset >= part.stop:
            return
        yield line


def _packed(parts: Iterable[Part], size: int) -> list[Task]:
    """Neighbours together, while they have no more bytes than ``size``."""
    out, held = [], 0
    for part in parts:
        if not out or held + part.size > size:
            out.append(Task([]))
            held = 0
        out[-1].parts.append(part)
        held += part.size
    return out


def _read(archive: str, parts: Iterable[Part]) -> Iterator[tuple[str, Iterator[str]]]:
    """(member, lines); each member's lines are taken before the next member is."""
    with ExitStack() as held:
        f = held.enter_context(_open(archive))
        z = held.enter_context(zipfile.ZipFile(f)) if archive.lower().endswith(".zip") else None
        for part in parts:
            if part.start is not None:
                yield part.member, _texts(_stretch_lines(f, part))
            elif z is not None:
                with z.open(part.member) as m:
                    yield part.member, _texts(line for _, line in _lines(_blocks(m)))
            else:
                with tarfile.open(fileobj=f, mode="r|*") as t:
                    for m in t:
                        if m.isfile() and (not part.member or m.name.rsplit("/", 1)[-1] == part.member):
                            yield m.name, _texts(line for _, line in _lines(_blocks(t.extractfile(m))))


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.member, self.stretch = options["path"], options.get("member"), int(options.get("stretch", STRETCH))

    def partitions(self) -> list[Task]:
        plan = lambda a: (_zip_parts if a.lower().endswith(".zip") else _tar_parts)(a, self.member, self.stretch)
        with ThreadPoolExecutor(16) as pool:  # waits for storage, a directory each
            return _packed((p for parts in pool.map(plan, _found(self.path)) for p in parts), self.stretch)

    def read(self, task) -> Iterator[pa.RecordBatch]:
        """Rows of small members share batches."""
        names = ["archive", "member", "value"]
        rows = ((archive, member, line) for archive, parts in groupby(task.parts, lambda p: p.archive) for member, lines in _read(archive, parts) for line in lines) if isinstance(task, Task) else iter(())
        while held := list(islice(rows, BATCH_LINES)):
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*held)], names=names)


class ArchiveLines(DataSource):
    """Options: ``path``; ``member``, the base name of the members wanted, else all of a tar and the preferred one of a zip;
    ``stretch``, bytes a task reads of an uncompressed member."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "archive string, member string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, member: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """(archive, member, value): lines in their order; partitions follow archives, members and stretches.

    A file, folder or pattern of .zip, .tar and compressed .tar archives, on any storage that pyarrow opens. Members without
    a line give no row, and so do archives without a wanted member; an archive that can't be opened fails the query.
    """
    spark.dataSource.register(ArchiveLines)
    own = spark.read.format(NAME).option("stretch", stretch)
    return (own.option("member", member) if member else own).load(path)

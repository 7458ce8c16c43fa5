"""Members of ZIP and TAR archives as a data source: spark.read.format("archives").load(path).

An archive is read where it lies and never whole: a ZIP file by its directory
and then by member, a TAR file as a stream. A partition is one archive, or
several small ones, so that tasks grow with the bytes. Filters on the
member's name reach the reader, so other members are not unpacked. What cannot
be read, or is larger than the limits allow, is a row with an error and never
a missing row.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from longwatch.sources.convert import MAX_FILE_BYTES, MAX_MEMBERS, MAX_RATIO, ConversionError, best_member, shown_member

SCHEMA = "path string, ord int, name string, size long, content binary, error string"
_CHUNK = 1 << 16
#: What reading a damaged archive can raise.
_UNREADABLE = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, NotImplementedError, RuntimeError, pa.ArrowInvalid)


#: Archives of a partition, and their bytes unless it is a single one, at most.
_TOGETHER, _TOGETHER_BYTES = 64, 4 << 20


@dataclass
class Archives(InputPartition):
    uri: str
    files: list[tuple[str, int]]  #: paths and sizes


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:"):]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Writes a file at once, for tasks that make archives; written twice it is the same file."""
    source, at = _at(path)
    source.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with source.open_output_stream(at) as out:
        out.write(data)


class _Seekable(io.RawIOBase):
    """A file of Arrow that tells a place before its start as zipfile expects it."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.file.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError("no such place") from e

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)


def limited(handle, most: int) -> bytes:
    """All bytes of a stream, or ConversionError as soon as there are more than so many."""
    parts, total = [], 0
    while chunk := handle.read(min(_CHUNK, most - total + 1)):
        total += len(chunk)
        if total > most:
            raise ConversionError("member too large")
        parts.append(chunk)
    return b"".join(parts)


def _accepts(f: Filter, name: str | None) -> bool | None:
    """Whether a name passes a filter; None for a filter that names do not decide."""
    if getattr(f, "attribute", None) != ("name",):
        return None
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return name == f.value
    if isinstance(f, In):
        return name in f.value
    tests = {StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__}
    test = tests.get(type(f))
    return None if test is None else name is not None and test(name, f.value)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.wanted = options.get("member")
        self.choose = options.get("choose", "false").lower() == "true" or self.wanted is not None
        self.most_bytes = int(options.get("maxmemberbytes", MAX_FILE_BYTES))
        self.most_ratio = float(options.get("maxratio", MAX_RATIO))
        self.most_members = int(options.get("maxmembers", MAX_MEMBERS))
        self.most_file = int(options.get("maxarchivebytes", MAX_FILE_BYTES))
        self.filters: list[Filter] = []
        if min(self.most_bytes, self.most_members, self.most_file) < 1 or not self.most_ratio > 0:
            raise ValueError("limits of archives must be positive")  # (S12)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if _accepts(f, "") is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Archives]:
        source, path = _at(self.path)
        info = source.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in source.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file]
        # hidden files and those of unfinished writes are no archives
        real = [f for f in found if not f.base_name.startswith(("_", "."))]
        out: list[Archives] = []
        bytes_ = 0
        for f in sorted(real, key=lambda f: f.path):
            if not out or len(out[-1].files) >= _TOGETHER or bytes_ + f.size > _TOGETHER_BYTES:
                out.append(Archives(self.path, []))
                bytes_ = 0
            out[-1].files.append((f.path, f.size))
            bytes_ += f.size
        return out

    def _asked(self, name: str | None) -> bool:
        return all(_accepts(f, name) for f in self.filters)

    def read(self, partition: Archives):
        source = _at(partition.uri)[0]
        for path, size in partition.files:
            yield from self._archive(source, path, size)

    def _archive(self, source: pafs.FileSystem, path: str, size: int):
        try:
            if size > self.most_file:
                raise ConversionError("archive too large")
            with source.open_input_file(path) as f:
                zipped = f.read(4)[:2] == b"PK"
                f.seek(0)
                yield from self._zip(path, f) if zipped else self._tar(path, source)
        except ConversionError as e:
            if self._asked(None):
                yield path, None, None, None, None, str(e)
        except _UNREADABLE:
            if self._asked(None):
                yield path, None, None, None, None, "unreadable archive"

    def _names(self, names: list[str]) -> set[int]:
        """Places of the members to read."""
        if len(names) > self.most_members:
            raise ConversionError("too many members")
        if self.choose:
            return {names.index(best_member(names, self.wanted))}
        return {k for k, n in enumerate(names) if shown_member(n)}

    def _zip(self, path: str, f):
        with zipfile.ZipFile(io.BufferedReader(_Seekable(f))) as z:
            members = [m for m in z.infolist() if not m.is_dir()]
            wanted = self._names([m.filename for m in members])
            for k, m in enumerate(members):
                if k not in wanted or not self._asked(m.filename):
                    continue
                if m.file_size > self.most_bytes or m.file_size / max(m.compress_size, 1) > self.most_ratio:
                    yield path, k, m.filename, m.file_size, None, "member too large"
                    continue
                try:
                    with z.open(m) as member:
                        yield path, k, m.filename, m.file_size, limited(member, self.most_bytes), None
                except ConversionError as e:
                    yield path, k, m.filename, m.file_size, None, str(e)
                except _UNREADABLE:
                    yield path, k, m.filename, m.file_size, None, "unreadable member"

    def _tar(self, path: str, source):
        # names first where one is chosen: a stream has no directory
        wanted = None
        if self.choose:
            with source.open_input_stream(path) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                wanted = self._names(self._files(t))
        with source.open_input_stream(path) as f, tarfile.open(fileobj=f, mode="r|*") as t:
            k = -1
            for m in t:
                if not m.isfile():
                    continue
                k += 1
                if k >= self.most_members:
                    raise ConversionError("too many members")
                if (k not in wanted if wanted is not None else not shown_member(m.name)) or not self._asked(m.name):
                    continue
                if m.size > self.most_bytes:
                    yield path, k, m.name, m.size, None, "member too large"
                else:
                    yield path, k, m.name, m.size, limited(t.extractfile(m), self.most_bytes), None

    def _files(self, t: tarfile.TarFile) -> list[str]:
        names: list[str] = []
        for m in t:
            names += [m.name] if m.isfile() else []
            if len(names) > self.most_members:
                raise ConversionError("too many members")
        return names


class ArchiveSource(DataSource):
    """Members of the archives of a folder, or of one archive.

    Options: member (the one by its end or base name), choose (only the one to
    convert, by kind), maxMemberBytes, maxRatio, maxMembers, maxArchiveBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters sent to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def packed(kind: str, members: list[tuple[str, bytes]]) -> bytes:
    """An archive of members, the same bytes for the same members."""
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members:
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in members:
                m = tarfile.TarInfo(name)
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
    return out.getvalue()

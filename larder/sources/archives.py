"""Zipped recipe archives as a data source that is split by members."""

from __future__ import annotations

import gzip
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larder.functions.shipping import ship

ship(__name__)

ENDING = ".paprikarecipe"
SCHEMA = "archive string, entry string, record string, error string"


class Members(InputPartition):
    """A range of the members of one archive, by their places in its list of contents; or why it has none."""

    def __init__(self, path: str, start: int, stop: int, error: str | None = None):
        self.path, self.start, self.stop, self.error = path, start, stop, error


class Seekable:
    """An Arrow file whose impossible seeks are the errors that zip readers expect."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        self.read, self.tell, self.close = file.read, file.tell, file.close

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.file.seek(at, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e

    def __enter__(self) -> Seekable:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def opened(path: str) -> Seekable:
    """A readable, seekable file of any file system that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        files, inside = fs.FileSystem.from_uri(path)
    else:
        files, inside = fs.LocalFileSystem(), path
    return Seekable(files.open_input_file(inside))


def found(path: str) -> list[str]:
    """The files that a path with wildcards names, or that stand in a folder."""
    import fnmatch
    import posixpath

    scheme, rest = path.split(":", 1) if path.startswith("file:") else ("", path)
    files, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), rest)
    prefix = path[: len(path) - len(inside)] if "://" in path else ""
    wild = any(c in inside for c in "*?[")
    (info,) = files.get_file_info([inside]) if not wild else (None,)
    if not wild and info.type == fs.FileType.File:
        return [path]
    folder = posixpath.dirname(inside) if wild else inside
    names = [i.path for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File]
    return sorted(prefix + n for n in names if not wild or fnmatch.fnmatchcase(posixpath.basename(n), posixpath.basename(inside)))


class Reader(DataSourceReader):
    def __init__(self, path: str, members: int):
        self.path, self.members = path, max(1, members)

    def partitions(self) -> list[Members]:
        """Only the lists of contents are read here, and of them only how long they are."""
        out = []
        for path in found(self.path):
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    n = len(z.infolist())
                out += [Members(path, i, min(i + self.members, n)) for i in range(0, n, self.members)]
            except (OSError, zipfile.BadZipFile) as e:
                out.append(Members(path, 0, 0, f"{type(e).__name__}: {e}"))
        return out or [Members("", 0, 0)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition.error is not None:
            yield batch([(partition.path, None, None, partition.error)])
        if partition.start < partition.stop:
            with opened(partition.path) as f, zipfile.ZipFile(f) as z:
                for info in z.infolist()[partition.start : partition.stop]:
                    if info.filename.endswith(ENDING):
                        try:
                            row = (partition.path, info.filename, json.dumps(json.loads(gzip.decompress(z.read(info)))), None)
                        except (OSError, ValueError, EOFError, zipfile.BadZipFile, zipfile.zlib.error) as e:
                            row = (partition.path, info.filename, None, f"{type(e).__name__}: {e}")
                        yield batch([row])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["archive", "entry", "record", "error"])


class RecipeArchive(DataSource):
    """``spark.read.format("recipe_archive").option("members", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "recipe_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("members", 256)))

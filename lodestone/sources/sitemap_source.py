"""Sitemaps as a data source: ``spark.dataSource.register(SitemapSource)``, then ``spark.read`` or ``spark.readStream.format("sitemaps")``.

Files lie under ``path``, in any file system that Arrow knows, plain or gzipped. Tasks read files in blocks: no file is held whole. One that
cannot be read, or only in part, gives a row with its error and null address after what was read, and the others go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith,
)

SCHEMA = "file string, url string, error string"
_ARROW = pa.schema([("file", pa.string()), ("url", pa.string()), ("error", pa.string())])
#: Bytes of a read, rows of a batch, bytes of files for one task, and bytes after which an address that does not end is none.
BLOCK, ROWS, TASK_BYTES, LONGEST = 1 << 20, 10_000, 128 << 20, 1 << 16
_LOC = re.compile(rb"<loc>\s*(.*?)\s*</loc>", re.DOTALL)
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def addresses(stream) -> Iterator[str]:
    """The addresses of a sitemap that is read block by block; what may be the start of one waits for the next block."""
    held = b""
    while block := stream.read(BLOCK):
        held += block
        end = 0
        for m in _LOC.finditer(held):
            end = m.end()
            if len(m[1]) > LONGEST:
                continue
            text = m[1].decode("utf-8", "replace")
            for entity, character in _ENTITIES:
                text = text.replace(entity, character)
            yield text
        rest = held[end:]
        at = rest.find(b"<loc>")
        held = rest[-4:] if at < 0 else rest[at:]
        if len(held) > LONGEST:
            at = held.rfind(b"<loc>")
            held = held[at:] if 0 <= at and len(held) - at <= LONGEST else held[-4:]


class Files(InputPartition):
    """Files for one task, by URI or path."""

    def __init__(self, files: list[str]) -> None:
        self.files = files


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of the last change in nanoseconds, path, bytes) of the files under a folder, or of one file; hidden ones and those that
    begin with an underscore are left out."""
    system, at = _open(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((f.mtime_ns or 0, scheme + f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def children(index: str) -> list[str]:
    """The files beside an index that the last parts of its addresses name, each once: missing ones, too, as they are errors of a task."""
    system, at = _open(index)
    folder = index.rsplit("/", 1)[0]
    with system.open_input_stream(at, compression="detect") as stream:
        names = [url.split("?")[0].rstrip("/").rsplit("/", 1)[-1] for url in addresses(stream)]
    return [f"{folder}/{n}" for n in dict.fromkeys(names) if n]


def planned(files: list[tuple[str, int]], task_bytes: int) -> list[Files]:
    """Files in their order, shared out to tasks of about ``task_bytes``; a larger file is a task of its own."""
    tasks: list[Files] = []
    room = 0
    for name, size in files:
        if not tasks or size > room:
            tasks.append(Files([]))
            room = task_bytes
        tasks[-1].files.append(name)
        room -= size
    return tasks


def rows(part: Files, prefixes: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The rows of a task's files; addresses begin with all ``prefixes``."""
    for name in part.files:
        urls: list[str] = []
        error = None
        batch = lambda urls, errors: pa.RecordBatch.from_arrays([pa.array([name] * len(urls), pa.string()), pa.array(urls, pa.string()), pa.array(errors, pa.string())], schema=_ARROW)  # noqa: E731, B023
        try:
            system, at = _open(name)
            with system.open_input_stream(at, compression="detect") as stream:
                for url in addresses(stream):
                    if all(url.startswith(p) for p in prefixes):
                        urls.append(url)
                    if len(urls) == ROWS:
                        yield batch(urls, [None] * ROWS)
                        urls = []
        except (OSError, pa.ArrowInvalid) as e:
            error = str(e).splitlines()[0]
        if urls:
            yield batch(urls, [None] * len(urls))
        if error is not None and not prefixes:
            yield batch([None], [error])


class SitemapReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.index = options["path"], str(options.get("index", "false")).lower() == "true"
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.prefixes: tuple[str, ...] = ()
        self.only: set[str] | None = None

    def partitions(self):
        if self.index:
            sizes = {name: size for _, name, size in listed(self.path.rsplit("/", 1)[0])}
            files = [(name, sizes.get(name, 0)) for name in children(self.path)]
        else:
            files = [(name, size) for _, name, size in listed(self.path)]
        return planned([f for f in files if self.only is None or f[0] in self.only], self.task_bytes) or [Files([])]

    def read(self, partition):
        return rows(partition, self.prefixes)


class PushingReader(SitemapReader):
    """A reader of its own, as Spark refuses one that takes filters where spark.sql.python.filterPushdown.enabled is off."""

    def pushFilters(self, filters):
        """Beginnings of addresses and names of files are looked at where files are read."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("url",):
                self.prefixes += (f.value,)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = set(f.value) if isinstance(f, In) else {f.value}
                self.only = names if self.only is None else self.only & names
            else:
                yield f


class SitemapStream(DataSourceStreamReader):
    """Files in the order of their last change, then of their names: an offset is the last file that was read. A file that is changed is read
    again; one that comes with an earlier time than those already read is not seen."""

    def __init__(self, options) -> None:
        self.path, self.task_bytes = options["path"], int(options.get("taskBytes", TASK_BYTES))

    def initialOffset(self):
        return {"time": -1, "file": ""}

    def latestOffset(self):
        files = listed(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start, end):
        after, upto = (start["time"], start["file"]), (end["time"], end["file"])
        return planned([(name, size) for time, name, size in listed(self.path) if after < (time, name) <= upto], self.task_bytes)

    def read(self, partition):
        return rows(partition)

    def commit(self, end) -> None:
        """Files stay where they are."""


class SitemapSource(DataSource):
    """Options: ``path`` (a folder or file), ``index`` (true: the file is an index, whose children lie beside it; batch alone), ``taskBytes``, ``pushFilters``."""

    @classmethod
    def name(cls) -> str:
        return "sitemaps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if str(self.options.get("pushFilters", "false")).lower() == "true" else SitemapReader)(self.options)

    def streamReader(self, schema):
        return SitemapStream(self.options)

"""Text files as a data source: ``spark.read.format("lodestar_documents").load(folder)`` after register_documents(spark).

A partition is a group of files of about ``bytes`` bytes, so that neither many small files nor one large one decides how many
tasks there are. Each file's parser follows from its name; what it can't read is a row with an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.sources.files import decoded

SCHEMA = "path string, page long, text string, preserves_layout boolean, error string"
#: Bytes of files in one partition, about.
BYTES = 64 << 20


class ParseError(ValueError):
    """What makes a document unreadable for good, in a word."""


def _text(data: bytes) -> list[str]:
    text = decoded(data)
    if text is None:
        raise ParseError("encoding")
    return [text]


def _form_feeds(data: bytes) -> list[str]:
    """Pages that form feeds end, as text that was taken from a PDF has them; only an empty last one is none."""
    pages = _text(data)[0].split("\f")
    return pages[:-1] if pages[-1] == "" else pages


#: Pages by extension, and whether lines keep their layout.
PARSERS: dict[str, tuple[Callable[[bytes], list[str]], bool]] = {"txt": (_text, False), "md": (_text, True), "markdown": (_text, True), "pages": (_form_feeds, False)}


@dataclass
class Group(InputPartition):
    files: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int, most: int) -> None:
        self.path, self.size, self.most = path, size, most

    def _found(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Group]:
        store, path = self._found()
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
        groups, held, total = [], [], 0
        for f in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            if held and total + f.size > self.size:
                groups.append(Group(held))
                held, total = [], 0
            held.append(f.path)
            total += f.size
        return [*groups, Group(held)]

    def read(self, partition: Group) -> Iterator[tuple]:
        store, _ = self._found()
        for path in partition.files:
            ext = path.rpartition(".")[2].lower()
            if ext not in PARSERS:
                yield path, None, None, None, "no parser"
                continue
            parse, layout = PARSERS[ext]
            try:
                with store.open_input_stream(path) as f:
                    data = f.read(self.most + 1)
                if len(data) > self.most:
                    raise ParseError("size")
                pages = parse(data)
            except ParseError as e:
                yield path, None, None, layout, str(e)
                continue
            except OSError:
                yield path, None, None, layout, "unreadable"
                continue
            for i, text in enumerate(pages, 1):
                yield path, i, text, layout, None


class Documents(DataSource):
    """Options: path, bytes (of a partition), most (bytes of a file; beyond that it is an error, as uploads have a limit)."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("bytes", BYTES)), int(self.options.get("most", 8192 * 1024)))


def register_documents(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)

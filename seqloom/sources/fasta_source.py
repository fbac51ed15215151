"""FASTA as a data source: ``spark.read.format("fasta").load(path)`` after ``register(spark)``.

Splits are planned from the sizes of the files, as ranges of bytes.  A record belongs to the split that its header begins in and carries its offset
in the file, so records and their order are the same whatever the split size, and one scan tells both.  Files are reached through Arrow's file systems
(local paths, HDFS, S3, GCS); for any other store that Spark reads there is read_fasta().

Options: ``headSep`` (>), ``lineSep`` (nothing), ``splitBytes`` (128 MB), ``strict`` (true: text before a file's first header raises an error; false: it is
skipped).  Empty files, and lines without letters before the first header, give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 20
ROWS, CHARS = 2_000, 1 << 23
SCHEMA = "ext_id string, description string, seq string, source_file string, split_start bigint, split_row bigint"
_ARROW = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.head = options["path"], options.get("headSep", ">").encode()
        self.join, self.split = options.get("lineSep", ""), int(options.get("splitBytes", 128 << 20))
        self.strict = options.get("strict", "true").lower() == "true"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:/") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Range]:
        """Ranges of the file, or of the folder's files but hidden ones, in order of name."""
        store, at = self._store()
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, s, min(s + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.split)]

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(offset, line) from the first line that begins in the range or, if a file is read from its start, from there; beyond its end too."""
        store, _ = self._store()
        with store.open_input_file(part.path) as f:
            at = max(part.start - 1, 0)  # the byte before tells whether a line begins at the start
            f.seek(at)
            rest, skip = b"", part.start > 0
            while block := f.read(BLOCK):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if not skip:
                        yield at, line
                    skip, at = False, at + len(line) + 1
            if rest and not skip:
                yield at, rest

    def _records(self, part: Range) -> Iterator[tuple[int, str, list[str]]]:
        found = None
        for at, line in self._lines(part):
            line = line.removesuffix(b"\r")
            if line.startswith(self.head):
                if found:
                    yield found
                if at >= part.end:
                    return
                found = (at, line[len(self.head):].decode(), [])
            elif found:
                found[2].append(line.decode())
            elif at >= part.end:
                return  # the range lies within a record of another one
            elif part.start == 0 and line.strip() and self.strict:
                raise ValueError(f"no header at the start of {part.path}")
        if found:
            yield found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for at, head, lines in self._records(partition):
            while lines and not lines[-1]:
                lines.pop()
            name = re.match(r"\S*", head)[0]
            rows.append((name, head[len(name):].lstrip(), self.join.join(lines), partition.path, partition.start, at))
            chars += len(head) + len(rows[-1][2])
            if len(rows) >= ROWS or chars >= CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FastaSource)
    return spark

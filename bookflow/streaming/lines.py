"""Numbered lines as a stream whose offset is the next line's number."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from bookflow.sources.files import store

#: Lines of a task.
SPLIT_LINES = 100_000


@dataclasses.dataclass
class Span(InputPartition):
    """Lines `first` to `end` - 1."""

    first: int
    end: int


def opened(path: str) -> ds.Dataset:
    files, root = store(path)
    return ds.dataset(root, filesystem=files, format="parquet")


def next_line(path: str, index: str) -> int:
    """One more than the largest line number, from the files' footers; a file without statistics is looked through."""
    last = -1
    for part in opened(path).get_fragments():
        at = part.physical_schema.get_field_index(index)
        for group in range(part.metadata.num_row_groups):
            stats = part.metadata.row_group(group).column(at).statistics
            if stats is None or not stats.has_min_max:
                found = pc.max(part.to_table(columns=[index]).column(0)).as_py()
                last = max(last, -1 if found is None else found)
                break
            last = max(last, stats.max)
    return last + 1


class LineReader(DataSourceStreamReader):
    """Offsets are {"line": n}: lines before n have been read. Files are asked for a span's lines alone."""

    def __init__(self, path: str, index: str, first: int, until: int | None, split: int, names: list[str]):
        self.path, self.index, self.first, self.until, self.split, self.names = path, index, first, until, split, names

    def initialOffset(self) -> dict:
        return {"line": self.first}

    def latestOffset(self) -> dict:
        end = next_line(self.path, self.index)
        return {"line": max(self.first, end if self.until is None else min(end, self.until))}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(low, min(low + self.split, end["line"])) for low in range(start["line"], end["line"], self.split)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        at = pc.field(self.index)
        wanted = (at >= partition.first) & (at < partition.end)
        yield from (b for b in opened(self.path).to_batches(columns=self.names, filter=wanted, batch_size=10_000) if len(b))


class NumberedLines(DataSource):
    """Parquet files with a column of line numbers as a stream. Options: path, index (that column), first, until (stop there; lines behind it are for a later run), split."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> StructType:
        return from_arrow_schema(opened(self.options["path"]).schema)

    def streamReader(self, schema: StructType) -> LineReader:
        until = self.options.get("until")
        return LineReader(self.options["path"], self.options.get("index", "line_index"), int(self.options.get("first", 0)), None if until is None else int(until), int(self.options.get("split", SPLIT_LINES)), schema.fieldNames())


def stream_lines(spark: SparkSession, path: str, index: str = "line_index", until: int | None = None, split: int = SPLIT_LINES) -> DataFrame:
    """The lines of Parquet files below `path` in order of their number, as a stream.

    Its checkpoint holds the number of the next line and no list of files, so a query that starts again goes on there
    and reads none of the lines before it. Lines are expected behind those that are there; one that is added with a
    number that has been passed is not read. `until` bounds a run. `path` is one that executors can open.
    """
    spark.dataSource.register(NumberedLines)
    reader = spark.readStream.format("numbered_lines").option("path", path).option("index", index).option("split", str(split))
    return (reader if until is None else reader.option("until", str(until))).load()

"""Files by name: one file for each row, all of them or none."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from bookflow.sources.shared import cut

#: Files that a task moves at once.
MOVERS = 32
#: Files that a task reads at once, and bytes after which it gives their rows on.
READERS = 8
READ_BYTES = 1 << 24
WAITING = "_waiting-"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that executors and driver can open, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def clean_name(name: str) -> str:
    """A relative path below the root; names that would lead out of it, or are empty, are refused."""
    norm = posixpath.normpath(name or "")
    if norm in (".", "") or norm.startswith(("/", "..")) or norm.split("/")[0].startswith(WAITING):
        raise ValueError(f"no name for a file: {name!r}")
    return norm


def waiting(batches: Iterator[pa.RecordBatch], path: str, job: str) -> Iterator[pa.RecordBatch]:
    """Files of the rows (name, content) in a folder of this attempt's own; gives (name, folder)."""
    files, root = store(path)
    folder, made = f"{root}/{WAITING}{job}/{uuid.uuid4().hex}", set()
    for batch in batches:
        names = [clean_name(n) for n in batch.column(0).to_pylist()]
        for name, content in zip(names, batch.column(1), strict=True):
            parent = posixpath.dirname(f"{folder}/{name}")
            if parent not in made:
                files.create_dir(parent, recursive=True)
                made.add(parent)
            with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(content.as_buffer() or b"")
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([folder] * len(names), pa.string())], ["name", "folder"])


def refused(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Fails where one of the names is there; gives nothing."""
    files, root = store(path)
    for batch in batches:
        there = [x.path for x in files.get_file_info([f"{root}/{n}" for n in batch.column(0).to_pylist()]) if x.type != fs.FileType.NotFound]
        if there:
            raise FileExistsError(there[0])
        yield batch.slice(0, 0)


def moved(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Moves the files (name, folder) to their places; one that an earlier attempt has moved is there. Gives nothing."""
    files, root = store(path)
    made = set()

    def move(source: str, target: str) -> None:
        try:
            files.move(source, target)
        except OSError:
            gone = files.get_file_info(source).type == fs.FileType.NotFound
            if not gone or files.get_file_info(target).type == fs.FileType.NotFound:
                raise

    with ThreadPoolExecutor(MOVERS) as pool:
        for batch in batches:
            moves = [(f"{folder}/{n}", f"{root}/{n}") for n, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            for parent in {posixpath.dirname(target) for _, target in moves} - made:
                files.create_dir(parent, recursive=True)
                made.add(parent)
            list(pool.map(lambda m: move(*m), moves))
            yield batch.slice(0, 0)


def write_named(rows: DataFrame, path: str, name: Column, content: Column, mode: str = "append") -> None:
    """A file `name` below `path` for each row. A task that is tried again leaves nothing twice.

    Mode append keeps the names that are there and refuses to write one again; overwrite replaces them. Each attempt
    of a task writes to a folder of its own, and the names of those that count are a table. Only when it is whole, and
    no name is there twice or refused, are the files moved: a job that fails before has written nothing, and removes what
    its tasks wrote; one that is killed, or a store that fails while files are moved, may leave files and a folder
    `_waiting-`, which no reader sees.

    Two rows of one name, a null or empty name, and names that lead out of the folder are errors; null content is an
    empty file. Names are checked and files moved in tasks; the driver holds neither.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"no mode for files by name: {mode!r}")
    path, job, parts = path.rstrip("/"), uuid.uuid4().hex, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        own = rows.select(name.alias("name"), content.cast("binary").alias("content"))
        made = cut(own.mapInArrow(lambda batches: waiting(batches, path, job), "name string, folder string"))
        twice = made.groupBy("name").count().filter("count > 1").first()
        if twice:
            raise ValueError(f"two rows for the file {twice['name']!r}")
        spread = made.repartition(parts)
        if mode == "append":
            spread.mapInArrow(lambda batches: refused(batches, path), made.schema).count()
        spread.mapInArrow(lambda batches: moved(batches, path), made.schema).count()
    finally:
        files, root = store(path)
        if files.get_file_info(f"{root}/{WAITING}{job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{WAITING}{job}")


def read_named(rows: DataFrame, path: str, name: Column) -> DataFrame:
    """`rows` with `content`, the bytes of each row's file `name` below `path`; a file that is missing is an error.

    Files are opened by name in the tasks and no folder is listed, so that empty files and all names come back as they were written.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(path.rstrip("/"))

        def content(n: str) -> bytes:
            with files.open_input_stream(f"{root}/{clean_name(n)}", compression=None) as f:
                return f.read()

        with ThreadPoolExecutor(READERS) as pool:
            for batch in batches:
                names, own = batch.column(batch.num_columns - 1).to_pylist(), batch.columns[:-1]
                done, size, found = 0, 0, []
                for i in range(0, len(names), READERS):
                    found += pool.map(content, names[i : i + READERS])
                    size += sum(map(len, found[i - done :]))
                    if size >= READ_BYTES or i + READERS >= len(names):
                        yield pa.RecordBatch.from_arrays([*(c.slice(done, len(found)) for c in own), pa.array(found, pa.binary())], schema.names)
                        done, size, found = done + len(found), 0, []

    schema = StructType(rows.schema.fields).add("content", BinaryType())
    return rows.withColumn("_name", name).mapInArrow(read, schema)


def chapter_name(book: Column, number: Column) -> Column:
    """`book/number.txt`, characters that no path should hold replaced."""
    return F.concat(F.regexp_replace(book.cast("string"), r"[/\\:*?\"<>|\x00-\x1f]", "_"), F.lit("/"), number.cast("string"), F.lit(".txt"))

"""Book archives as tables."""

from __future__ import annotations

import dataclasses
import io
import posixpath
import sys
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import store

MEMBERS = "book string, infix string, path string, size long, content binary, error string"
#: Members whose bytes are kept; of the others the size alone.
TEXTS = (".xhtml", ".html", ".htm", ".xml", ".opf", ".ncx", ".txt", ".css")
#: Bytes of archives for a task, bytes of a batch of members, and bytes of a member that fit a cell with room to spare.
SPLIT_BYTES, BATCH_BYTES, MEMBER_BYTES = 64 << 20, 32 << 20, 1 << 30


def _unzipped(root: str, keep: tuple[str, ...]):
    base = root.rstrip("/") + "/"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rest = path.split(base, 1)[-1]
                infix, name = posixpath.split(rest)
                book = name.rsplit(".", 1)[0]
                rows = []
                if book.endswith(" "):
                    rows.append((book, infix, "", 0, None, "the name ends in a space"))
                else:
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            for m in z.infolist():
                                if not m.is_dir():
                                    own = m.filename.lower().endswith(keep)
                                    rows.append((book, infix, posixpath.normpath(m.filename), m.file_size, z.read(m) if own else None, None))
                    except (zipfile.BadZipFile, NotImplementedError, EOFError, RuntimeError) as e:
                        rows.append((book, infix, "", 0, None, str(e)))
                yield pd.DataFrame(rows, columns=["book", "infix", "path", "size", "content", "error"])

    return run


def unzipped(files: DataFrame, root: str = "", keep: tuple[str, ...] = TEXTS) -> DataFrame:
    """S1 on archives at hand: one row (book, infix, path, size, content, error) for each member of each file (path, content)."""
    return files.select("path", "content").mapInPandas(_unzipped(root, keep), MEMBERS)


@dataclasses.dataclass
class Share(InputPartition):
    """Byte ranges of archives for one task: members whose headers begin in a range are its own."""

    ranges: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    """Archives below a root, dealt by bytes: a large one to several tasks, small ones together to one.

    The driver lists names and sizes; each task reads a directory of members itself, and then only its own members.
    """

    def __init__(self, root: str, keep: tuple[str, ...], split: int):
        self.root, self.keep, self.split = root, keep, split

    def partitions(self) -> list[Share]:
        files, root = store(self.root)
        shares, own, room = [], [], self.split
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        for x in sorted((x for x in found if x.is_file and x.base_name.endswith(".epub")), key=lambda x: x.path):
            for low in range(0, max(x.size, 1), self.split):
                high = min(low + self.split, x.size)
                if own and high - low > room:
                    shares.append(Share(own))
                    own, room = [], self.split
                own.append((x.path, low, high if high < x.size else sys.maxsize))
                room -= high - low
        return [*shares, Share(own)]  # without archives one share of nothing: Spark gives None to `read` where there is no partition

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        files, root = store(self.root)
        rows: list[tuple] = []
        size = 0
        for path, low, high in partition.ranges:
            for row in self.members(files, root, path, low, high):
                rows.append(row)
                size += len(row[4] or b"") + 200
                if size > BATCH_BYTES:
                    yield as_batch(rows)
                    rows, size = [], 0
        if rows:
            yield as_batch(rows)

    def members(self, files: fs.FileSystem, root: str, path: str, low: int, high: int) -> Iterator[tuple]:
        infix, name = posixpath.split(path.removeprefix(root).lstrip("/"))
        book = name.rsplit(".", 1)[0]
        if book.endswith(" "):
            if not low:
                yield book, infix, "", 0, None, "the name ends in a space"
            return
        try:
            with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                for m in z.infolist():
                    if low <= m.header_offset < high and not m.is_dir():
                        yield self.member(z, m, book, infix)
        except (zipfile.BadZipFile, NotImplementedError, EOFError, RuntimeError, OSError, pa.ArrowException) as e:
            if not low:  # once for an archive
                yield book, infix, "", 0, None, str(e)

    def member(self, z: zipfile.ZipFile, m: zipfile.ZipInfo, book: str, infix: str) -> tuple:
        name = posixpath.normpath(m.filename)
        if not m.filename.lower().endswith(self.keep):
            return book, infix, name, m.file_size, None, None
        if m.file_size > MEMBER_BYTES:
            return book, infix, name, m.file_size, None, "too large for a cell"
        try:
            return book, infix, name, m.file_size, z.read(m), None
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError) as e:
            return book, infix, name, m.file_size, None, str(e)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class Archives(DataSource):
    """Read only: the members of all `*.epub` below the option `path`. Options keep (endings, comma-joined) and split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], tuple(self.options.get("keep", ",".join(TEXTS)).split(",")), int(self.options.get("split", SPLIT_BYTES)))


def read_archives(spark: SparkSession, root: str, keep: tuple[str, ...] = TEXTS, split: int = SPLIT_BYTES) -> DataFrame:
    """One row (book, infix, path, size, content, error) for each member of each `*.epub` below `root`.

    infix is the folder below the root. Content is kept for text members alone. A task reads about `split` bytes of
    archives, so one of any size is spread over tasks, and no archive is ever a cell. An archive that cannot
    be read, or whose name ends in a space, is one row with `error`; so is a broken member, and a text of over 1 GB.
    `root` is a path or URI that executors can open; `read_whole_archives` is for stores that only Spark reads.
    """
    spark.dataSource.register(Archives)
    return spark.read.format("archives").option("path", root).option("keep", ",".join(keep)).option("split", str(split)).load()


def read_whole_archives(spark: SparkSession, root: str, keep: tuple[str, ...] = TEXTS) -> DataFrame:
    """S1 through Spark's own reader of files, in any store; an archive is one cell, and so at most 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(root)
    return unzipped(files, root, keep)


PACKAGE = "book string, part string, ord int, id string, path string, media_type string, properties string"


def _package(pdf: pd.DataFrame) -> pd.DataFrame:
    """The manifest and spine rows of one book, from its container and package files."""
    content = dict(zip(pdf["path"], pdf["content"], strict=True))
    rows: list[tuple] = []
    book = pdf["book"].iloc[0]
    bare = lambda tag: tag.rsplit("}", 1)[-1]
    try:
        container = ET.fromstring(content["META-INF/container.xml"])
        root = posixpath.normpath(next(x.attrib["full-path"] for x in container.iter() if bare(x.tag) == "rootfile"))
        package = ET.fromstring(content[root])
    except (KeyError, StopIteration, ET.ParseError, TypeError):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKAGE.split(", ")])
    base = posixpath.dirname(root)
    for part in package:
        kind = bare(part.tag)
        if kind not in ("manifest", "spine"):
            continue
        for i, x in enumerate(part):
            if kind == "manifest":
                rows.append((book, kind, i, x.attrib.get("id", ""), posixpath.normpath(posixpath.join(base, x.attrib.get("href", ""))), x.attrib.get("media-type", ""), x.attrib.get("properties")))
            else:
                rows.append((book, kind, i, x.attrib.get("idref", ""), None, None, None))
        if kind == "spine" and len(part) == 0:
            rows.append((book, kind, 0, "", None, None, None))  # there is a spine, and it names nothing
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKAGE.split(", ")])


def package_tables(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest (book, ord, id, path, media_type, properties) and spine (book, ord, idref). Books without a package have no rows.

    Only the container and package files are moved to their book's task.
    """
    small = members.filter(F.endswith("path", F.lit(".opf")) | F.endswith("path", F.lit("container.xml"))).select("book", "path", "content")
    rows = small.groupBy("book").applyInPandas(_package, PACKAGE)
    manifest = rows.filter("part = 'manifest'").select("book", "ord", "id", "path", "media_type", "properties")
    return manifest, rows.filter("part = 'spine'").select("book", "ord", F.col("id").alias("idref"))


def member_texts(members: DataFrame) -> DataFrame:
    """(book, path, html): the text members decoded as UTF-8."""
    return members.filter("content IS NOT NULL AND error IS NULL").select("book", "path", F.col("content").cast("string").alias("html"))

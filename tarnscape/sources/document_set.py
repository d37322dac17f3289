"""Sets of JSON documents in storage, one file a document, of which a whole set becomes visible at once."""

from __future__ import annotations

import heapq
import io
import json
import uuid
from collections.abc import Iterator
from itertools import islice, pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "document_set"


def _storage(path: str):
    """A file system and the path on it: a URI that Arrow knows (file, s3, hdfs, ...), or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(fs, at: str, text: str) -> None:
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(text.encode())


#: Names in one list: as many a task holds at once, and reads at most.
LIST = 4096


class _Lists(WriterCommitMessage):
    """The lists of names that a task has written, and how many names each has."""

    def __init__(self, lists: list[tuple[str, int]]):
        self.lists = lists


class _Writer(DataSourceWriter):
    """Tasks write documents and lists of their names to a folder that nothing points to; the commit names the lists and moves the pointer, in one step.

    So no name goes through the driver's memory, but for one of each list while they are merged."""

    def __init__(self, path: str, ordered: bool):
        self.path, self.set, self.ordered = path, uuid.uuid4().hex, ordered

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, root = _storage(self.path)
        base = f"{root}/sets/{self.set}"
        lists, names, last, folder = [], [], None, None

        def listed() -> None:
            at = f"_lists/{uuid.uuid4().hex}"
            _put(fs, f"{base}/{at}", "".join(json.dumps(n) + "\n" for n in sorted(names)))
            lists.append((at, len(names)))
            names.clear()

        for r in rows:
            name, doc = r["name"], r["doc"]
            if not name or name.startswith(("/", "_")) or ".." in name.split("/") or doc is None:
                raise ValueError(f"no document, or no name for one: {name!r}")
            if self.ordered and name == last:
                raise ValueError(f"documents of one name: {[name]}")
            at = f"{base}/{name}"
            if folder != (folder := at.rsplit("/", 1)[0]):
                fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(doc.encode())
            last = name
            names.append(name)
            if len(names) == LIST:
                listed()
        if names:
            listed()
        return _Lists(lists)

    def commit(self, messages: list) -> None:
        fs, root = _storage(self.path)
        base = f"{root}/sets/{self.set}"
        lists = [x for m in messages if m for x in m.lists]
        if not self.ordered:
            for a, b in pairwise(heapq.merge(*[_lines(fs, f"{base}/{at}") for at, _ in lists])):
                if a == b:
                    self.abort(messages)
                    raise ValueError(f"documents of one name: {[a]}")
        _put(fs, f"{base}/_documents", json.dumps(lists))
        _put(fs, f"{root}/_next-{self.set}", self.set)
        fs.move(f"{root}/_next-{self.set}", f"{root}/current")

    def abort(self, messages: list) -> None:
        fs, root = _storage(self.path)
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/sets/{self.set}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/sets/{self.set}")


def _lines(fs, at: str) -> Iterator[str]:
    with fs.open_input_stream(at) as f, io.BufferedReader(f) as lines:
        for x in lines:
            yield json.loads(x)


class _Part(InputPartition):
    def __init__(self, set_: str, names: str | None, first: int, end: int):
        super().__init__(set_)
        self.set, self.names, self.first, self.end = set_, names, first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list:
        fs, root = _storage(self.path)
        with fs.open_input_stream(f"{root}/current") as f:
            now = f.read().decode()
        with fs.open_input_stream(f"{root}/sets/{now}/_documents") as f:
            lists = json.loads(f.read())
        return [_Part(now, at, i, i + self.per_task) for at, n in lists for i in range(0, n, self.per_task)] or [_Part(now, None, 0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        fs, root = _storage(self.path)
        base = f"{root}/sets/{partition.set}"
        for name in islice(_lines(fs, f"{base}/{partition.names}"), partition.first, partition.end) if partition.names else ():
            with fs.open_input_stream(f"{base}/{name}") as f:
                yield name, f.read().decode()


class DocumentSet(DataSource):
    """Spark's format "document_set": (name, doc) rows as files under ``path``.

    Writing replaces the set: readers see all of the old documents or all of the new ones,
    and a write that fails leaves the old ones and no file of its own. Two documents of one
    name, and rows without a name or text, fail the write. The set that was there before
    stays in its folder, for readers that are under way, until prune() is called."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, doc string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("per_task", LIST)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("ordered") == "true")


def write_documents(docs: DataFrame, path: str) -> None:
    """Writes (name, doc) as the set at ``path``.

    Rows are dealt out by name and sorted, so a task sees names that come twice, and a folder's documents together."""
    spark = docs.sparkSession
    spark.dataSource.register(DocumentSet)
    dealt = docs.select("name", "doc").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").sortWithinPartitions("name")
    dealt.write.format(FORMAT).option("ordered", "true").mode("append").save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, doc): the set at ``path``."""
    spark.dataSource.register(DocumentSet)
    return spark.read.format(FORMAT).load(path)


def prune(path: str) -> int:
    """Deletes all sets but the current one; how many they were. Also what writes that were killed have left."""
    fs, root = _storage(path)
    from pyarrow.fs import FileSelector

    with fs.open_input_stream(f"{root}/current") as f:
        now = f.read().decode()
    old = [x.path for x in fs.get_file_info(FileSelector(f"{root}/sets")) if x.base_name != now]
    for x in old:
        fs.delete_dir(x)
    return len(old)

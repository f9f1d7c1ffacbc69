"""A tree of files as a Spark data source, read and written: ``spark.read.format("tree")`` and ``df.write.format("tree")``.

Reading. The driver looks at the folders of the first ``depth`` levels and
deals them out to tasks; files are listed and opened in the tasks, so there is no list of files
on the driver. Unlike Spark's own file sources it keeps names that begin with ``_``.

    path        root of the tree
    suffixes    comma-separated; in any case unless ``exact`` is true
    hidden      true keeps names with a dot in front, and what lies below such folders; what lies above the root doesn't count
    recursive   false reads the root's own files only
    content     false gives null contents, and opens no file
    depth       levels of folders that are dealt out (2: one piece of work per shard folder), default 2
    tasks       tasks at most, default 1024; a task has FOLDERS folders at least

Writing. Rows (key, content) become one file each at ``ab/cd/abcd....suffix`` (or ``key.suffix``
with ``sharded`` false). A task writes all its files under temporary names in a hidden folder of the
job and renames them at its end; so a task that fails leaves no file, whether its error is
handled or its executor lost, and one that runs again gives the same files.
An aborted job takes back the files that weren't there before, those of tasks that end after it, too. Rows with one key overwrite each other; a
key that is null or empty is an error, as is one with a slash in sharded trees, or a dot in front.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .storage import exists, opened, removed


FOLDERS = 32


@dataclass
class _Folders(InputPartition):
    """Folders of a task, each with whether it is read to the bottom."""

    folders: list[tuple[str, bool]]


@dataclass
class _Done(WriterCommitMessage):
    files: int
    bytes: int


def _yes(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


class Tree(DataSource):
    """Files as rows, and rows as files."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, rel string, length long, modified timestamp, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a tree is only appended to")
        return _TreeWriter(dict(self.options), [f.name for f in schema.fields])


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.suffixes = tuple("." + s.strip().lstrip(".") for s in options.get("suffixes", "").split(",") if s.strip())
        self.exact, self.hidden = _yes(options, "exact", False), _yes(options, "hidden", False)
        self.recursive, self.content = _yes(options, "recursive", True), _yes(options, "content", True)
        self.depth, self.tasks = int(options.get("depth", 2)), int(options.get("tasks", 1024))
        if not self.exact:
            self.suffixes = tuple(s.lower() for s in self.suffixes)

    def _seen(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.root)
        if not exists(system, root):
            raise FileNotFoundError(self.root)
        found, level = [], [root]
        for depth in range(self.depth + 1 if self.recursive else 1):
            last = depth == self.depth
            found += [(folder, last) for folder in level]
            if not last:
                level = [x.path for folder in level for x in system.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and self._seen(x.base_name)]
        n = min(-(-len(found) // FOLDERS), self.tasks)
        return [_Folders(found[k::n]) for k in range(n)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        system, root = opened(self.root)
        for folder, deep in partition.folders:
            for x in sorted(system.get_file_info(fs.FileSelector(folder, recursive=deep)), key=lambda x: x.path):
                rel = x.path[len(root) :].lstrip("/")
                name = x.base_name if self.exact else x.base_name.lower()
                if x.type != fs.FileType.File or (self.suffixes and not (name.endswith(self.suffixes) and "." + name.rpartition(".")[2] in self.suffixes and name.rpartition(".")[0])) or not all(map(self._seen, rel.split("/"))):
                    continue
                content = None
                if self.content:
                    with system.open_input_stream(x.path) as f:
                        content = f.read()
                yield f"{self.root.rstrip('/')}/{rel}", rel, x.size, x.mtime, content


class _TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str]):
        self.root, self.suffix = options["path"], options.get("suffix", "npz").lstrip(".")
        self.sharded, self.names = _yes(options, "sharded", True), names
        self.job = f".tree-{uuid.uuid4().hex}"
        if not {"key", "content"} <= set(names):
            raise ValueError("a tree is written from the columns key and content")
        system, root = opened(self.root)
        system.create_dir(f"{root}/{self.job}")
        with system.open_output_stream(f"{root}/{self.job}/open") as out:
            out.write(b"")

    def _place(self, key: str | None) -> str:
        parts = (key or "").split("/")
        if (self.sharded and len(parts) > 1) or not all(p and not p.startswith(".") for p in parts):
            raise ValueError(f"{key!r} can't be a file's name")
        return f"{key[:2]}/{key[2:4]}/{key}.{self.suffix}" if self.sharded else f"{key}.{self.suffix}"

    def _is_open(self, system: fs.FileSystem, root: str) -> None:
        if not exists(system, f"{root}/{self.job}/open"):
            raise RuntimeError("the job is over")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        system, root = opened(self.root)
        self._is_open(system, root)
        task = f"{root}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(task)
        places, size, new = [], 0, []
        try:
            for batch in iterator:
                columns = dict(zip(self.names, batch.columns, strict=True))
                for key, content in zip(columns["key"].to_pylist(), columns["content"].to_pylist(), strict=True):
                    data = content.encode() if isinstance(content, str) else content or b""
                    place = self._place(key)
                    with system.open_output_stream(f"{task}/{len(places)}") as out:
                        out.write(data)
                    places.append(place)
                    size += len(data)
            # What will be new is said before it is there, and looked for by a job that breaks off. A task that goes on
            # after its job has ended finds that out at its end, and takes its files back itself.
            self._is_open(system, root)
            new = [f"{root}/{place}" for place in dict.fromkeys(places) if not exists(system, f"{root}/{place}")]
            with system.open_output_stream(f"{task}/new") as out:
                out.write("\n".join(new).encode())
            self._is_open(system, root)
            for folder in {place.rpartition("/")[0] for place in places}:
                system.create_dir(f"{root}/{folder}")
            for k, place in enumerate(places):
                system.move(f"{task}/{k}", f"{root}/{place}")
            self._is_open(system, root)
        except BaseException:
            self._taken_back(system, new)
            over = not exists(system, f"{root}/{self.job}/open")
            removed(system, f"{root}/{self.job}" if over else task)
            raise
        return _Done(len(places), size)

    @staticmethod
    def _taken_back(system: fs.FileSystem, paths: list[str]) -> None:
        for path in paths:
            removed(system, path)

    def commit(self, messages: list[_Done | None]) -> None:
        system, root = opened(self.root)
        removed(system, f"{root}/{self.job}")

    def abort(self, messages: list[_Done | None]) -> None:
        system, root = opened(self.root)
        job = f"{root}/{self.job}"
        removed(system, f"{job}/open")
        for x in system.get_file_info(fs.FileSelector(job, recursive=True, allow_not_found=True)):
            if x.base_name == "new":
                try:
                    with system.open_input_stream(x.path) as f:
                        listed = f.read().decode().split("\n")
                except FileNotFoundError:
                    continue  # Its task has seen that the job is over, and takes its files back.
                self._taken_back(system, [path for path in listed if path])
        removed(system, job)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tree)

"""A working tree as a data source: every file below a folder with its bytes, or the reason why they are not there.

The folders are dealt to tasks, which list and read them where they run; the driver lists only as many folders as it takes to have
some for each task. Links are not followed, submodules are not entered. The tree must be there on every executor.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Why a file's bytes are not (or not as text) in a snapshot.
LINK, SUBMODULE, UNREADABLE, OVERSIZED, ENCODING = "symlink", "submodule", "unreadable", "oversized", "unsupported_encoding"
NEVER = (".git",)
#: Folders that tasks share, at least, if the tree has so many.
SPREAD = 64


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _entries(root: str, folder: str) -> Iterator[tuple[str, os.DirEntry]]:
    """(path below the root, entry) in the order of names."""
    with os.scandir(os.path.join(root, folder)) as found:
        for e in sorted(found, key=lambda e: e.name):
            if e.name not in NEVER:
                yield (f"{folder}/{e.name}" if folder else e.name), e


def _is_submodule(path: str) -> bool:
    return os.path.isfile(os.path.join(path, ".git"))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, limit: int):
        self.root, self.limit = root, limit

    def partitions(self) -> list[Folder]:
        """Folders level by level until there are SPREAD of them: those above only for their own files, the last with all below."""
        shallow, level = [], [""]
        while level and len(shallow) + len(level) < SPREAD:
            below = []
            for folder in level:
                try:
                    below += [p for p, e in _entries(self.root, folder) if e.is_dir(follow_symlinks=False) and not _is_submodule(e.path)]
                except OSError:
                    continue  # its task says so
            shallow, level = shallow + level, below
        return [Folder(p, False) for p in shallow] + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                entries = list(_entries(self.root, folder))
            except OSError as e:
                yield (folder, 0, None, UNREADABLE, e.strerror)
                continue
            for path, entry in entries:
                if entry.is_symlink():
                    yield (path, 0, None, LINK, "links are not followed")
                elif entry.is_dir(follow_symlinks=False):
                    if _is_submodule(entry.path):
                        yield (path, 0, None, SUBMODULE, "another repository's files")
                    elif partition.deep:
                        todo.append(path)
                else:
                    yield self._file(path, entry)

    def _file(self, path: str, entry: os.DirEntry) -> tuple:
        size = 0
        try:
            info = entry.stat(follow_symlinks=False)
            size = info.st_size
            if not stat.S_ISREG(info.st_mode):
                return (path, 0, None, UNREADABLE, "no regular file")
            if size > self.limit:
                return (path, size, None, OVERSIZED, f"more than {self.limit} bytes")
            with open(entry.path, "rb") as f:
                return (path, size, f.read(), None, None)
        except OSError as e:
            return (path, size, None, UNREADABLE, e.strerror)


class Tree(DataSource):
    """spark.read.format("tree").option("path", folder).option("limit", bytes)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, bytes binary, issue string, detail string"

    def reader(self, schema) -> TreeReader:
        root = self.options["path"]
        return TreeReader(os.path.abspath(root.removeprefix("file://")), int(self.options.get("limit", 16 << 20)))

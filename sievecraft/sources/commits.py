"""Numbered commits in a shared folder, each number taken by one writer only.

A table that several jobs write keeps its data in folders of their own and the list of
those that count in a commit. A writer reads the latest commit, writes data, and tries
to take the next number; if another one was faster it looks at what that one changed
and tries again. Readers follow the latest commit and never see half a change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Commits 0, 1, 2, ... of small JSON values below ``path``, on any file system that Spark reaches.

    A commit is a file that gets its name by a rename that fails where the name exists.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = self._hadoop.Path(path)
        self._fs = self._folder.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(self._folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(self._folder, f"{number:020}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and value of the last commit; -1 and {} before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def commit(self, number: int, value: dict) -> bool:
        """Takes ``number`` for ``value``; False if it is taken."""
        target, draft = (self._hadoop.Path(self._folder, name) for name in (f"{number:020}.json", f".{uuid.uuid4().hex}"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._folder.toUri(), self._conf)
        rename = getattr(self._hadoop, "Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, rename.NONE)
        try:
            context.rename(draft, target, options)
        except Exception as e:  # of the JVM; anything but a taken name is an error
            self._fs.delete(draft, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def remove(self, paths: list[str]) -> None:
        """Deletes data that no commit refers to any more."""
        for path in paths:
            self._fs.delete(self._hadoop.Path(path), True)

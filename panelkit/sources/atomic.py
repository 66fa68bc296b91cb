"""Writes of several tables by date that happen as a whole or can be finished later.

A :class:`Change` stages what it writes below the root, in a folder that readers don't see, and
then leaves a note of what goes where.  Only then are the folders of the dates it holds swapped,
which is a matter of renames.  A run that dies before the note has changed nothing; one that
dies after it is finished by :func:`recover`, which every change calls first.  On a store
without renames a swap is a copy, with the same guarantees.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

CHANGES, NOTE = "_changes", "note.json"


class Files:
    """The Hadoop file system that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        found = self._jvm.org.apache.hadoop.fs.Path(parts[0])
        for part in parts[1:]:
            found = self._jvm.org.apache.hadoop.fs.Path(found, part)
        return found

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self.path(*parts))

    def move(self, source, target) -> None:
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")

    def delete(self, *parts: str) -> None:
        self._fs.delete(self.path(*parts), True)

    def write(self, text: str, *parts: str) -> None:
        out = self._fs.create(self.path(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self.path(*parts))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text


class Change:
    """Tables to be written together; nothing shows before :meth:`commit`."""

    def __init__(self, spark: SparkSession, root: str):
        recover(spark, root)
        self.spark, self.root, self.number = spark, root, uuid.uuid4().hex
        self.tables: list[dict] = []

    def replace(self, df: DataFrame, table: str, by: str = "trade_date", dealt: bool = False) -> None:
        """Stages ``df`` as the whole content of the dates it holds; other dates stay.  Rows that are ``dealt`` by date stay in their tasks."""
        self._stage((df if dealt else df.repartition(by)).write.partitionBy(by), table, "replace")

    def append(self, df: DataFrame, table: str) -> None:
        """Stages ``df`` as further files of a table without partitions."""
        self._stage(df.write, table, "append")

    def _stage(self, writer, table: str, kind: str) -> None:
        staged = f"{CHANGES}/{self.number}/{len(self.tables)}"
        writer.mode("overwrite").parquet(f"{self.root}/{staged}")
        self.tables.append({"staged": staged, "table": table, "kind": kind})

    def commit(self) -> None:
        files = Files(self.spark, self.root)
        # a note is written elsewhere and renamed, so it's there whole or not at all
        files.write(json.dumps(self.tables), self.root, CHANGES, self.number, NOTE + ".new")
        files.move(files.path(self.root, CHANGES, self.number, NOTE + ".new"), files.path(self.root, CHANGES, self.number, NOTE))
        _swap(files, self.root, self.number)


def _swap(files: Files, root: str, number: str) -> None:
    for table in json.loads(files.read(root, CHANGES, number, NOTE)):
        for name in files.names(root, table["staged"]):
            if name.startswith(("_", ".")):
                continue
            target = files.path(root, table["table"], name)
            if table["kind"] == "replace" and files.exists(root, table["table"], name):
                files.delete(root, table["table"], name)
            files.move(files.path(root, table["staged"], name), target)
    files.delete(root, CHANGES, number)


def recover(spark: SparkSession, root: str) -> int:
    """Finishes changes that have their note and drops the others; returns how many were finished."""
    files, done = Files(spark, root), 0
    for number in files.names(root, CHANGES):
        if files.exists(root, CHANGES, number, NOTE):
            _swap(files, root, number)
            done += 1
        else:
            files.delete(root, CHANGES, number)
    return done

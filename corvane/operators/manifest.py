"""Numbered manifests: small JSON files that say which folders make up a set of tables, all of them flipped by one rename."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders made where spark.checkpoint.dir is unset, by application.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, which only a
    local master can share; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in OWN:
            OWN[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        found = OWN[app]
    return found.rstrip("/")


class Manifest:
    """A manifest counts once its file, named by its number, is there. It is written under another name and renamed, so a reader sees
    the whole of it or the one before, and a writer that dies at any point leaves folders that no manifest names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._read = spark, root.rstrip("/"), {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name) -> str:
        return f"{self.root}/manifests/{name}"

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def number(self) -> int:
        """The last one's, 0 if there is none."""
        return max(self.numbers(), default=0)

    def read(self, number: int | None = None) -> dict:
        number = number or self.number()
        if number and number not in self._read:  # a manifest never changes
            self._read[number] = self.spark.read.text(self._file(number), wholetext=True).first()[0]
        return json.loads(self._read[number]) if number else {}

    def commit(self, content: dict, after: int) -> int:
        """Make `content` the manifest that follows number `after`; an error if another writer has made one meanwhile."""
        draft = self._path(self._file(f"_{uuid.uuid4().hex}"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        new = self._path(self._file(after + 1))
        self._read.pop(after + 1, None)
        if self.number() != after or not self._fs.rename(draft, new):
            raise RuntimeError(f"another writer has made manifest {after + 1} of {self.root}")
        return after + 1

    def forget(self, keep: int = 2) -> list[dict]:
        """Drop all manifests but the last ones; returns what the dropped ones said."""
        old = self.numbers()[:-keep]
        said = [self.read(n) for n in old]
        for n in old:
            self.drop(self._file(n))
            self._read.pop(n, None)
        return said

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        """Names in a folder, none if it isn't there."""
        at = self._path(path)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

"""Small files beside the tables, read and replaced through Hadoop's file system API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder that the driver and every executor see."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path("", path.rstrip("/")).getFileSystem(self._conf)
        self.root = self.fs.makeQualified(self.path("", path.rstrip("/"))).toString()

    def path(self, name: str, root: str | None = None):
        root = self.root if root is None else root
        return self._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}" if name else root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        """What stands in a folder below this one, sorted; nothing if there is none."""
        p = self.path(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str | None:
        p = self.path(name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, content: str) -> None:
        """Write beside, flush to disk, then rename over the old file in one step: readers see the old or the new."""
        tmp, to = self.path(f".{name.replace('/', '_')}.{uuid.uuid4().hex}"), self.path(name)
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(content.encode()))
            out.hsync()
        finally:
            out.close()
        self.fs.mkdirs(to.getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(tmp, to, how)

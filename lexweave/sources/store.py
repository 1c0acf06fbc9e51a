"""Small files and renames in any store that Spark reaches, through Hadoop's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """The file system of `root`; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def full(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.full(name))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, sorted; nothing where it is missing."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)))

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._path(new).getParent())
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"can't move {self.full(old)} to {self.full(new)}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: str) -> None:
        self.fs.mkdirs(self._path(name).getParent())
        out = self.fs.create(self._path(name), False)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()

    def claim(self, name: str, content: str) -> bool:
        """Create a file with its whole content if there is none of that name; of many that try, one succeeds.

        The content is written aside and then gets its name. A distributed store refuses to rename onto a file; a local disk
        would replace it, so there a hard link is made, which fails where the name is taken.
        """
        aside = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self._write(aside, content)
        try:
            if self.fs.getScheme() == "file":
                files, java = self._jvm.java.nio.file.Files, self._jvm.java.io.File
                try:
                    files.createLink(java(self._path(name).toUri().getPath()).toPath(), java(self._path(aside).toUri().getPath()).toPath())
                    return True
                except Exception as error:
                    if "FileAlreadyExistsException" not in str(error):
                        raise
                    return False
            return not self.exists(name) and bool(self.fs.rename(self._path(aside), self._path(name)))
        finally:
            self.delete(aside)

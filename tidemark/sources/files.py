"""Small files and names on any file system that Spark reads; rows never pass through here."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session
    gets a temporary folder, and any other session one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = f"file://{tempfile.mkdtemp(prefix='work-')}" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Folder:
    """A folder by its URL. Names are relative to it."""

    def __init__(self, spark: SparkSession, url: str):
        self.url = url.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at, self._bytes = self._jvm.org.apache.hadoop.fs.Path, self._jvm.org.apache.commons.io.IOUtils  # a look-up by name is many calls
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self._at(f"{self.url}/{name}" if name else self.url)

    def at(self, name: str) -> str:
        return f"{self.url}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, sub: str = "", files_only: bool = False) -> list[tuple[str, int]]:
        """(name, bytes) in name order, names with a leading dot or underscore included."""
        if sub and not self.exists(sub):
            return []
        found = self._fs.listStatus(self._path(sub))
        return sorted((s.getPath().getName(), s.getLen()) for s in found if not files_only or s.isFile())

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._bytes.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        """The file appears whole or not at all."""
        folder, _, last = name.rpartition("/")
        part = self._path(f"{folder}/.{last}.part" if folder else f".{last}.part")
        local = self._fs.getScheme() == "file"
        stream = (self._fs.getRawFileSystem() if local else self._fs).create(part, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        if local:  # a checksum file beside the target would be of its former content
            self._fs.getRawFileSystem().delete(self._fs.getChecksumFile(self._path(name)), False)
            os.replace(part.toUri().getPath(), self._path(name).toUri().getPath())
        else:
            self._move(part, self._path(name), "OVERWRITE")

    def rename(self, name: str, to: str) -> None:
        """Fails where `to` is there already."""
        self._fs.mkdirs(self._path(to).getParent())
        try:
            self._move(self._path(name), self._path(to), "NONE")
        except Exception as e:
            raise OSError(f"could not rename {self.at(name)} to {self.at(to)}") from e

    def _move(self, source, target, how: str) -> None:
        fs = self._jvm.org.apache.hadoop.fs
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, next(x for x in kind.getEnumConstants() if x.name() == how))
        fs.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, options)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

"""File operations through Hadoop's file system, so that any path Spark can write works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FileSystem:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def make(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def rename(self, source: str, target: str) -> None:
        fs, at = self._at(source)
        if not fs.rename(at, self._at(target)[1]):
            raise OSError(f"cannot rename {source} to {target}")

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def status(self, path: str) -> tuple[int, int]:
        """(size in bytes, modification time in ms) of a file."""
        fs, at = self._at(path)
        s = fs.getFileStatus(at)
        return s.getLen(), s.getModificationTime()

    def write_text(self, path: str, text: str) -> None:
        self.write_bytes(path, text.encode())

    def write_bytes(self, path: str, data: bytes) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(data))
        out.close()

    def read_text(self, path: str) -> str:
        fs, at = self._at(path)
        source = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def newest(self, folder: str, required: tuple[str, ...] = ()) -> str | None:
        """The newest subfolder (by time, then name) that holds the required files."""
        found = [(self.status(f"{folder}/{n}")[1], n) for n in self.names(folder) if all(self.exists(f"{folder}/{n}/{r}") for r in required)]
        return f"{folder}/{max(found)[1]}" if found else None

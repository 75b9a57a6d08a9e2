"""Small files in any file system that Spark reads: those that say which of the tables beside them count."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession


class Folder:
    """A folder, by paths relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def has(self, *parts: object) -> bool:
        return self._fs.exists(self._at(*parts))

    def names(self, *parts: object) -> list[str]:
        """Names in a folder, without those of files that are being written; none if it isn't there."""
        if not self.has(*parts):
            return []
        found = (f.getPath().getName() for f in self._fs.listStatus(self._at(*parts)))
        return sorted(n for n in found if n[0] not in "._")

    def read(self, *parts: object) -> str:
        stream = self._fs.open(self._at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def blocks(self, *parts: object) -> Iterator[bytes]:
        """The bytes of a file, some at a time."""
        stream = self._fs.open(self._at(*parts))
        try:
            while block := bytes(stream.readNBytes(1 << 20)):
                yield block
        finally:
            stream.close()

    def write_blocks(self, blocks: Iterable[bytes], *parts: object) -> None:
        """Writes a file that others know nothing of yet."""
        stream = self._fs.create(self._at(*parts), False)
        for block in blocks:
            stream.write(bytearray(block))
        stream.close()

    def write(self, data: bytes, *parts: object) -> None:
        self.write_blocks((data[at : at + (1 << 20)] for at in range(0, len(data), 1 << 20)), *parts)

    def create(self, text: str, *parts: object) -> bool:
        """Creates a file with its whole content at once; False, and nothing is changed, if it is there already.

        Of several processes that create one file one succeeds. The text is written
        under another name first: on a local disk a hard link gives it the right
        one, elsewhere a rename, which must refuse a target that is there, as HDFS does.
        """
        *above, name = map(str, parts)
        other = self._at(*above, f"_{uuid.uuid4().hex}")
        self.write(text.encode(), *above, other.getName())
        at = self._at(*above, name)
        if self._fs.getUri().getScheme() != "file":
            if not self._fs.exists(at) and self._fs.rename(other, at):
                return True
            self._fs.delete(other, False)
            return False
        try:
            os.link(other.toUri().getPath(), at.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            self._fs.delete(other, False)
        return True

    def delete(self, *parts: object) -> None:
        self._fs.delete(self._at(*parts), True)

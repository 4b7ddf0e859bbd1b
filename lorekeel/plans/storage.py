"""State on a file system that Spark reaches: versioned folders and small JSON files."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..errors import CorpusError


class Storage:
    """A state root. Small files are replaced by writing beside and renaming over (atomic)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def path(self, name: str) -> str:
        if name.startswith("/") or ".." in name.split("/"):
            raise CorpusError("a state path leads out of its root", "UNSAFE_PATH")
        return f"{self.root}/{name}"

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(name)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            body = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            value = json.loads(body)
        except ValueError as error:
            raise CorpusError(f"{name} is no JSON", "STATE_READ_FAILED") from error
        if not isinstance(value, dict):
            raise CorpusError(f"{name} holds no object", "STATE_READ_FAILED")
        return value

    def write_json(self, name: str, value: dict) -> None:
        """Keys sorted; readers see the old file or the new one, never a part."""
        beside = self._at(f"{name}.next")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
            stream.hsync()
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._conf)
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        files.rename(beside, self._at(name), options)

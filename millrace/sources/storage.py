"""Small files and folders in the store that driver and executors share, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where that is unset, a temporary folder that then becomes the session's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def files(self, name: str = "") -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of all files below, sorted."""
        if not self.exists(name):
            return []
        found, out = self._fs.listFiles(self._at(name), True), []
        while found.hasNext():
            x = found.next()
            out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
        return sorted(out)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file as a whole; False if there is one of that name (then nothing changes)."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._at(name), self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0))
            return True
        except Exception:
            self._fs.delete(draft, False)
            if self.exists(name):
                return False
            raise

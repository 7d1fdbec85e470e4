"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of a local session; a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kvlake-")
    return _LOCAL[app]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared one."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


class Files:
    """Files of any store that Spark reads, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it exists. The text is complete under its name or not there.

        Of two writers one wins where renaming onto an existing file fails, as on HDFS and local disks.
        A store without such a rename needs a lock of its own around this.
        """
        path = self._path(name)
        if self.fs.exists(path):
            return False
        part = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.exists(path) and self.fs.rename(part, path):
            return True
        self.fs.delete(part, False)
        return False

    def age(self, name: str) -> float:
        """Seconds since the file or folder last changed, by the driver's clock."""
        now = self.jvm.java.lang.System.currentTimeMillis()
        return (now - self.fs.getFileStatus(self._path(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

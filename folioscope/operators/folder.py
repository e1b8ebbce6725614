"""A folder on a shared file system whose steps are marked by files."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """The folder at ``path``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def _mark(self, name: str, overwrite: bool = True) -> None:
        """An empty file; without ``overwrite`` an error if it is there already."""
        fs, path = self._at(name)
        fs.create(path, overwrite).close()

    def _remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def _replace(self, name: str, source: str) -> None:
        """Puts ``source`` in the place of ``name``."""
        (fs, path), (_, old) = self._at(name), self._at(source)
        fs.delete(path, True)
        fs.mkdirs(path.getParent())
        if not fs.rename(old, path):
            raise OSError(f"{source} could not take the place of {name} in {self.path}")

    def _names(self, name: str) -> list[str]:
        """The names in a folder, without a leading ``batch=``."""
        fs, path = self._at(name)
        return [x.getPath().getName().removeprefix("batch=") for x in fs.listStatus(path)] if fs.exists(path) else []

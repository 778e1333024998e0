"""Small files on the store's own file system, which every node sees: JSON, marks, listings, renames."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    """The file system of a path, whatever it is of: local in tests, distributed or an object store on a cluster."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def create_new(self, path: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is."""
        fs, at = self._at(path)
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if fs.exists(at):
                return False
            raise OSError(str(e.java_exception)) from None
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def text(self, path: str) -> str | None:
        """The text of a small file; None if there is none."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return None
        data = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, old: str, new: str) -> bool:
        """Move a file or directory; False if another was faster or the new name is taken."""
        fs, at = self._at(old)
        _, to = self._at(new)
        if fs.exists(to):
            return False
        fs.mkdirs(to.getParent())
        try:
            return bool(fs.rename(at, to))
        except Py4JJavaError:
            return False

    def names(self, path: str) -> list[str]:
        """Names directly in a directory, sorted; none if it is missing."""
        fs, at = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def write_json(self, path: str, value: dict) -> None:
        """Replace a small JSON file: written beside it, then renamed."""
        fs, at = self._at(path)
        _, tmp = self._at(f"{path}.next")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(tmp, at):
            raise OSError(f"{path} could not be written")

    def read_json(self, path: str) -> dict:
        """The value of a JSON file; {} if there is none. A rename that was cut short is taken as done."""
        for name in (path, f"{path}.next"):
            text = self.text(name)
            if text:
                try:
                    got = json.loads(text)
                except ValueError:
                    continue
                if isinstance(got, dict):
                    return got
        return {}

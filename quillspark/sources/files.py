"""Small files on any Hadoop file system (local, HDFS, object stores), written so that readers never see half of one."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, content: str | bytes) -> None:
        fs, p = self._at(path)
        self._put(fs.create(p, True), content)

    def write_new(self, path: str, content: str) -> bool:
        """Whether the file was written; one that is there already is left as it is."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        aside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
        self._put(fs.create(aside, False), content)
        try:
            # a rename fails where the target has come to be in the meantime, and readers see whole files only
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
            context.rename(context.makeQualified(aside), context.makeQualified(p), self._no_options())
            return True
        except Py4JJavaError:
            fs.delete(aside, False)
            if fs.exists(p):
                return False
            raise

    def _no_options(self) -> object:
        return SparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)

    @staticmethod
    def _put(stream: object, content: str | bytes) -> None:
        try:
            stream.write(bytearray(content.encode("utf-8") if isinstance(content, str) else content))
        finally:
            stream.close()

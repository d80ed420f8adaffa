"""Small files that appear whole or not at all, on any Hadoop file system: what commits are made of."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Names, texts and commits below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{name}"))

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self._path(f"{self.root}/{name}"), True)

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether this call made the file; it appears by a rename that fails where one of that name is there."""
        draft = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(f"{self.root}/{name}")
        self.fs.mkdirs(target.getParent())
        hadoop = self.jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = getattr(hadoop.Options.Rename, "NONE")
        context = hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), options)
        except Exception:
            self.fs.delete(draft, False)
            if not self.fs.exists(target):
                raise
            return False
        return True

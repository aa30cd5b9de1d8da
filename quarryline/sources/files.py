"""Small files by Hadoop's file systems: whatever Spark can read, this can."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        hadoop = self.jvm.org.apache.hadoop.fs
        self.root = hadoop.Path(root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs, self.context = self.root.getFileSystem(conf), None
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces the file in one step: readers see the old text or the new one."""
        part = self.path(name + ".part")
        self.fs.mkdirs(part.getParent())
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        self.context.rename(part, self.path(name), kinds)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

"""Small files and listings on whatever file system the table lives on, through Hadoop's client."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Stores without a rename of their own, whose clients publish an object whole when it is closed.
OBJECT_STORES = {"s3", "s3a", "s3n", "gs", "oss", "cosn", "obs", "wasb", "wasbs"}


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def uri(self) -> str:
        """The folder's whole address, as tasks need it that read and write files themselves."""
        return self._fs.makeQualified(self._path("")).toString()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Names directly below a folder, without hidden ones; none if it does not exist."""
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(path) if not (n := s.getPath().getName()).startswith("."))

    def walk(self, name: str, times: bool = False) -> Iterator[tuple[str, int]]:
        """Paths relative to ``name`` with size (or change time in ms) of all files below it."""
        path = self._path(name)
        if not self._fs.exists(path):
            return
        base = self._fs.getFileStatus(path).getPath().toString().rstrip("/") + "/"
        found = self._fs.listFiles(path, True)
        while found.hasNext():
            status = found.next()
            yield status.getPath().toString().removeprefix(base), status.getModificationTime() if times else status.getLen()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publish a new file, whole and exclusively: of several writers one gets ``True``, and no reader sees a part of it.

        The exclusive step depends on the file system. Locally a complete draft is hard-linked to the name, which fails if the
        name is taken. HDFS and its like rename a draft, which they refuse onto an existing file. An object store creates the
        object without overwriting, under the condition that it does not exist (clients that cannot state that condition,
        such as ``s3a`` before Hadoop 3.4.2, must not have two writers).
        """
        target = self._path(name)
        if self._fs.exists(target):
            return False
        self._fs.mkdirs(target.getParent())
        if self._fs.getUri().getScheme() in OBJECT_STORES:
            return self._create_object(target, text)
        draft = self._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
        self._put(self._fs.create(draft, True), text)
        try:
            if self._fs.getUri().getScheme() != "file":
                return self._fs.rename(draft, target)
            files, local = self._jvm.java.nio.file.Files, self._jvm.java.io.File
            files.createLink(local(target.toUri().getPath()).toPath(), local(draft.toUri().getPath()).toPath())
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    def _create_object(self, target, text: str) -> bool:
        try:
            builder = self._fs.createFile(target).overwrite(False)
            self._put(builder.opt("fs.option.create.conditional.overwrite", True).build(), text)
            return True
        except Py4JJavaError as error:
            if self._fs.exists(target):  # the client reports a lost race as an error of its own
                return False
            raise error

    @staticmethod
    def _put(stream, text: str) -> None:
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write or replace a file."""
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        self._put(self._fs.create(target, True), text)

    def replace_by(self, draft: str) -> None:
        """Let the folder ``draft`` take this one's place."""
        path = self._jvm.org.apache.hadoop.fs.Path(draft)
        self._fs.delete(self._path(""), True)
        if not self._fs.rename(path, self._path("")):
            raise OSError(f"cannot move {draft} to {self.root}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

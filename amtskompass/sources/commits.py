"""Versions of a table, committed optimistically.

A version is a small file that names the folders the table consists of.  Writers prepare new folders aside and then try to
create the file of the next version; the file system lets only one of them do it, the others read again and repeat.
Folders that no version names are never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class CommitLog:
    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{name}")

    def _files(self):
        path = self._path("x").getParent()
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        fs, path = self._files()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> int:
        """Newest version, -1 if there is none."""
        return max(self.versions(), default=-1)

    def read(self, version: int) -> dict:
        fs, _ = self._files()
        stream = fs.open(self._path(f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, payload: dict) -> bool:
        """Create ``version``; False if someone else has.  The file is written aside and renamed, so it is never seen in part."""
        fs, _ = self._files()
        aside, target = self._path(f".{uuid.uuid4().hex}.json"), self._path(f"{version:012d}.json")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(payload, sort_keys=True).encode()))
        stream.close()
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # fails if the target is there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), hadoop).rename(aside, target, options)
        except Py4JJavaError as refused:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(refused.java_exception):
                return False
            raise
        return True


def new_folder(root: str, kind: str) -> str:
    return f"{root}/{kind}-{uuid.uuid4().hex}"


def append_once(df: DataFrame, root: str, token: str) -> bool:
    """Append rows under a ``token``; a token that was appended before adds nothing and gives False.

    The rows are written to a folder of their own, so a job that is lost and repeated leaves at most a folder nobody reads.
    """
    log = CommitLog(df.sparkSession, root)
    folder = None
    while True:
        version = log.latest()
        before = log.read(version) if version >= 0 else {"parts": {}}
        if token in before["parts"]:
            return False
        if folder is None:
            folder = new_folder(root, "part")
            df.write.parquet(folder)
        if log.commit(version + 1, {"parts": before["parts"] | {token: folder}}):
            return True


def read_appended(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """All rows appended up to a version (default: the newest)."""
    log = CommitLog(spark, root)
    at = log.latest() if version is None else version
    parts = list(log.read(at)["parts"].values()) if at >= 0 else []
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def publish_json(df: DataFrame, root: str) -> int:
    """Replace a published result (JSON lines, one file per task): readers see the old or the new one, never a part."""
    log = CommitLog(df.sparkSession, root)
    folder = new_folder(root, "json")
    df.write.json(folder)
    while True:
        version = log.latest() + 1
        if log.commit(version, {"folder": folder}):
            return version


def read_published(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The result that was published last."""
    log = CommitLog(spark, root)
    return spark.read.schema(schema).json(log.read(log.latest())["folder"])

"""Session helpers: table reading, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where it lies."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where
    that is unset and Spark runs in this process alone a folder of this
    machine takes its place; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark)}/siltstone/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete what this package wrote to the shared folder; results that still read from it are lost."""
    delete_path(spark, f"{shared_dir(spark)}/siltstone")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts lineage the way a checkpoint does, but columnar and compressed, so
    the copy is small, survives the loss of any executor and carries exact
    size statistics for the planner.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class ManifestLog:
    """Numbered manifests in a folder; each number is given once, so of two writers one fails.

    A manifest appears whole or not at all: on local disks by a hard link, on
    HDFS by a rename that refuses an existing name, elsewhere by a create that
    does, where an object is visible once it is closed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{number:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        """The last number, -1 if there is none, and its manifest."""
        have = self.numbers()
        return (have[-1], self.read(have[-1])) if have else (-1, None)

    def _write(self, path, text: str) -> None:
        stream = self._fs.create(path, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def publish(self, number: int, manifest: dict) -> None:
        """The commit point; RuntimeError if the number is taken."""
        final, text = self._path(f"{self.folder}/{number:08d}.json"), json.dumps(manifest)
        scheme = self._fs.getUri().getScheme()
        taken = RuntimeError(f"commit {number} was taken by another writer")
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                return self._write(final, text)
            except Exception as e:
                if self._fs.exists(final):
                    raise taken from e
                raise
        staged = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        self._write(staged, text)
        try:
            if scheme == "file":
                try:
                    os.link(staged.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    raise taken from None
            elif not self._fs.rename(staged, final):
                raise taken
        finally:
            self._fs.delete(staged, False)

    def drop(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.folder}/{number:08d}.json"), False)


def folders(spark: SparkSession, parent: str) -> list[str]:
    """Names of the folders in a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(parent)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


def tokenizer_dir(spark: SparkSession | None = None) -> str:
    """Folder of the public vocabulary files (``siltstone.tokenizers``)."""
    conf = spark.conf.get("siltstone.tokenizers", None) if spark is not None else None
    return conf or os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")

"""Shared working tables: lineage is cut by writing Parquet to the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Workspace"] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """A private folder below the shared root, removed when the interpreter ends or ``close`` is called."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        #: Catalogue tables whose files lie in this folder.
        self.tables: list[str] = []
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
        """Write ``df`` once and read it back: a stable, recoverable table with no lineage. ``by`` names a column of folders."""
        at = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(at)
        return self.open(name, df.schema)

    def open(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        if self in _OPEN:
            _OPEN.remove(self)
            try:
                for name in self.tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self.drop()
            except Exception:  # noqa: BLE001  the session may be gone already
                pass


@contextmanager
def passing() -> Iterator[None]:
    """Workspaces opened inside are closed at the end; what is to outlive them must be written elsewhere by then."""
    before = list(_OPEN)
    try:
        yield
    finally:
        for work in [w for w in _OPEN if w not in before]:
            work.close()


@atexit.register
def _close_all() -> None:
    for work in list(_OPEN):
        work.close()

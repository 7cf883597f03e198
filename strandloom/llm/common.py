"""What the text operators share: table access, shipping of modules, column guards."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.workspace import Workspace, shared_root

__all__ = ["SPACE", "Workspace", "input_partitions", "shared_root", "ship", "table", "text_or_empty", "words_of"]

#: The white space of every contract here, for a Java or RE2 character class.
SPACE = r"\x20\x09-\x0D"
_SPACE_CHARS = " \t\n\u000b\f\r"
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of non-space characters, as an array; an empty array if there are none."""
    bare = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python stages import it by name."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    at = os.path.join(tempfile.mkdtemp(prefix="strandloom-ship-"), "strandloom_ship.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "strandloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)


def input_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

"""Helpers shared by the corpus operators: shared scratch tables and a few column expressions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and is deleted by normalisation: blank and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, below ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder; a cluster session without it is refused, as
    its executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="corpus-")
    return f"{base.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_names(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called c0, c1, ..., which no operator uses, and the new names of ``columns``."""
    place = {c.lower(): k for k, c in enumerate(df.columns)}
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), [f"c{place[c.lower()]}" for c in columns]


_shipped: set[str] = set()


def ship_code(df: DataFrame) -> DataFrame:
    """Sends this subpackage to the Python workers, once for each application, so that they can import its functions."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="corpus-code-"), "corpus_code.zip")
        with zipfile.ZipFile(path, "w") as archive:
            archive.write(os.path.join(os.path.dirname(here), "__init__.py"), "threatspark/__init__.py")
            for name in sorted(os.listdir(here)):
                if name.endswith(".py"):
                    archive.write(os.path.join(here, name), f"threatspark/llm/{name}")
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df


class WorkerCache(dict):
    """A bounded cache of a Python worker. A worker runs tasks of many operators one after the other: the cache of one is
    emptied when another operator begins."""

    _current: WorkerCache | None = None

    def begin(self) -> WorkerCache:
        before = WorkerCache._current
        if before is not None and before is not self:
            before.clear()
        WorkerCache._current = self
        return self

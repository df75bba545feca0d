"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lendwise
from lendwise.session import ensure_checkpoint_dir

ARROW_ROWS = 512
_SHIPPED: set[str] = set()
_RESIDENT: dict = {}
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before Python runs on the executors: few rows per Arrow batch (texts can be long, and a batch must fit a Python
    worker's memory), and this package sent along, once per context, for executors that don't have it installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="lendwise-code-")  # only the driver reads it; executors fetch from the driver
        root = Path(lendwise.__file__).parent
        with zipfile.ZipFile(archive := os.path.join(folder, "lendwise.zip"), "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


def resident(key: object, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps between tasks, such as a model with its word cache. Workers outlive a stage,
    so only the last one asked for is kept."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from (a null id hashes as the empty string)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder and read back: a cut of the lineage
    that survives lost executors and is computed once however often it is read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def content_key(*columns: str | Column) -> list[Column]:
    """Two 64-bit hashes of the given columns: a 128-bit key that is never null and does not depend on partitioning."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]

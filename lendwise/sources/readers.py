"""Sources: parquet / CSV scans, suffix dispatch, prefix discovery and input contracts.

All readers are lazy: they return a DataFrame whose scan Catalyst prunes and
filters. Nothing is materialised on the driver except file listings and
schema metadata.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARQUET_SUFFIXES = (".parquet", ".pq")
CSV_SUFFIXES = (".csv",)


def read_parquet(spark: SparkSession, uri: str, spread: bool = False) -> DataFrame:
    """Parquet scan (column pruning and filter pushdown are Catalyst's).

    With ``spread`` the rows are dealt round-robin over several tasks for each
    split of the scan; filters and pruning still reach the scan below it.
    Worth it only ahead of CPU-heavy per-row work (JSON decoding): for light
    scans the extra exchange costs more than it gains.
    """
    df = spark.read.parquet(uri)
    return spread_narrow(df) if spread else df


# Tasks for each split of a scan ahead of work that costs far more than reading: a split is cut by bytes alone, and a
# file of few row groups leaves most of its splits empty and the others long.
TASKS_PER_SPLIT = 8


def tasks_by_size(df: DataFrame) -> int:
    """A number of tasks that grows with the input: ``TASKS_PER_SPLIT`` a split, and no fewer than the cluster runs at once.

    Only planning metadata is read (the split count).
    """
    return max(TASKS_PER_SPLIT * df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)


# Rows of one task ahead of CPU-heavy work on each row: a split may hold millions of narrow, well compressed rows.
ROWS_PER_TASK = 25_000


def spread_narrow(df: DataFrame) -> DataFrame:
    """Round-robin a frame over tasks of at most about ``ROWS_PER_TASK`` rows, and no fewer than :func:`tasks_by_size`.

    What a task gets stays the same at any size, however few bytes a row takes. The rows of a plain parquet scan are
    counted from the file footers; no column is read.
    """
    return df.repartition(max(tasks_by_size(df), -(-df.count() // ROWS_PER_TASK)))


def read_csv(
    spark: SparkSession,
    uri: str,
    schema: StructType | str | None = None,
    header: bool = True,
    sep: str = ",",
) -> DataFrame:
    """CSV scan with a header row.

    With ``schema`` the scan is typed without an inference pass; without it
    types are inferred (one extra pass over the files — avoid at scale).
    """
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(uri)


def read_table(
    spark: SparkSession,
    uri: str,
    schema: StructType | str | None = None,
    csv_fallback: bool = False,
) -> DataFrame:
    """S3: dispatch on the file suffix, case-insensitively.

    ``.parquet``/``.pq`` → parquet, ``.csv`` → CSV; any other suffix raises
    ``ValueError`` (trainer / monitor policy). ``csv_fallback=True`` reads
    every non-parquet path as CSV (evaluator policy).
    """
    lower = uri.lower().rstrip("/")
    if lower.endswith(PARQUET_SUFFIXES):
        return read_parquet(spark, uri)
    if lower.endswith(CSV_SUFFIXES) or csv_fallback:
        return read_csv(spark, uri, schema=schema)
    known = ", ".join(PARQUET_SUFFIXES + CSV_SUFFIXES)
    raise ValueError(f"{uri!r} ends in none of {known}: no reader knows it")


def list_files(spark: SparkSession, prefix: str) -> list[str]:
    """File names directly under ``prefix`` through the Hadoop FileSystem API."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(prefix)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    return [status.getPath().toString() for status in fs.listStatus(path)]


LENDING_TABLES = ("base_submissao", "base_cadastral", "historico_emprestimos", "historico_parcelas")


def load_prefix_tables(
    spark: SparkSession,
    prefix: str,
    suffix: str,
    required: Iterable[str] = ("base_submissao",),
) -> dict[str, DataFrame]:
    """Pick ``{table}{suffix}`` under a prefix by exact file name.

    Returns a dict table-name → DataFrame; missing optional tables are
    absent from the dict; a missing required table raises ``RuntimeError``.
    Non-parquet files are read as CSV (evaluator policy).
    """
    found: dict[str, str] = {}
    names: list[str] = []
    for full in list_files(spark, prefix):
        names.append(full.rstrip("/").rsplit("/", 1)[-1])
        name = full.rstrip("/").rsplit("/", 1)[-1]
        for table in LENDING_TABLES:
            if name == f"{table}{suffix}":
                found[table] = full
    for table in required:
        if table not in found:
            raise RuntimeError(f"looked for {table}{suffix} in {prefix}, found {sorted(names)[:20]} ({len(names)} files)")
    return {t: read_table(spark, p, csv_fallback=True) for t, p in found.items()}


def require_columns(df: DataFrame, columns: Iterable[str], table: str = "table") -> DataFrame:
    """Fail when any required column is absent (schema metadata only)."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{table} missing columns required: {missing}")
    return df


def require_non_empty(df: DataFrame, table: str = "table") -> DataFrame:
    """Fail on an empty input. ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{table} must be a non-empty dataset")
    return df


def dictionary_columns(spark: SparkSession, uri: str, column: str = "coluna", sep: str = ";") -> DataFrame:
    """Distinct, trimmed, non-blank values of ``column`` in a ``;``-separated CSV."""
    raw = read_csv(spark, uri, schema=None, sep=sep)
    if column not in raw.columns:
        raise ValueError(f"dictionary {uri!r} has no column {column!r}")
    name = F.trim(F.col(column))
    return raw.select(name.alias(column)).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()


def project_to_columns(df: DataFrame, keep: Iterable[str], required: Iterable[str] = ()) -> DataFrame:
    """Keep ``required ∪ keep`` columns that exist, in the frame's own order.

    ``keep`` is a column-name list (schema-sized, e.g. a collected
    :func:`dictionary_columns` result), never row data.
    """
    wanted = set(keep) | set(required)
    return df.select([c for c in df.columns if c in wanted])

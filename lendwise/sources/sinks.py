"""Sinks: CSV reports, idempotent table DDL, schema reconcile and replay-safe appends.

Appends are replay-safe without a transactional table format: each
micro-batch writes its own partition, named by its writer and its number, with
dynamic partition overwrite, so re-running a batch replaces its rows
instead of duplicating them, and no other writer's.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv_report(df: DataFrame, uri: str, partitions: int | None = None) -> None:
    """CSV with a header, no index column, parents created, overwritten."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").option("header", True).csv(uri)


def with_file_count(df: DataFrame, partitions: int) -> DataFrame:
    """Control output file count; ``partitions <= 0`` leaves the plan alone."""
    return df.repartition(partitions) if partitions > 0 else df


def run_identity(spark: SparkSession, folder: str) -> str:
    """The lasting name of the writer that keeps its state in ``folder`` (a stream's checkpoint).

    Made at the first call and stored in the folder, so a restart finds it again and a new
    checkpoint, whose batches are numbered from 0 again, gets another one.
    """
    path = f"{folder.rstrip('/')}/writer-identity"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").write.mode("overwrite").text(path)
    return spark.read.text(path).first()["value"]


def append_batch(df: DataFrame, path: str, batch_id: int, partitions: int = 0, fmt: str = "parquet",
                 run_id: str | None = None) -> None:
    """S10 + ST3: append ``df`` to the table at ``path`` as partition ``run_id=<run>/batch_id=<id>``.

    Dynamic partition overwrite makes a replayed batch replace its own
    partition only. Batch numbers are unique within one writer alone, so the
    partition carries the writer's identity too (:func:`run_identity`);
    without one every call is a writer of its own and never replaces rows.
    """
    tagged = df.withColumn("run_id", F.lit(run_id or uuid.uuid4().hex)).withColumn(
        "batch_id", F.lit(int(batch_id)).cast("bigint"))
    (with_file_count(tagged, partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "batch_id").format(fmt).save(path))


def ensure_table(spark: SparkSession, table: str, columns: Sequence[tuple[str, str]], using: str = "parquet",
                 location: str | None = None) -> None:
    """``CREATE DATABASE/TABLE IF NOT EXISTS`` — safe to call on every start."""
    if "." in table:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
    cols = ", ".join(f"`{n}` {t}" for n, t in columns)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING {using}{loc}")


def reconcile_schema(spark: SparkSession, table: str, columns: Sequence[tuple[str, str]]) -> list[str]:
    """Add expected columns missing from ``table`` as nullable; never drop.

    Raises ``ValueError`` when an existing column has another type. Returns
    the names of added columns.
    """
    existing = {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}
    conflicts = [n for n, t in columns if n in existing and existing[n] != t.lower()]
    if conflicts:
        raise ValueError(f"{table}: type conflict on columns {conflicts}")
    missing = [(n, t) for n, t in columns if n not in existing]
    if missing:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS (" + ", ".join(f"`{n}` {t}" for n, t in missing) + ")")
    return [n for n, _ in missing]


class TableSink:
    """S10 + S12 + S13 + ST3: a catalog table that is created, reconciled, appended to, and compacted, safe on replay.

    Rows carry the ``run_id`` and ``batch_id`` of their writer: the ledger is
    in the data. A batch is written to a partition of its own (``part``), so
    a batch that runs again replaces itself. :meth:`compact` rewrites the
    batches there are into one partition of few files. It adds that
    partition in one step before it removes theirs, and :meth:`read` leaves
    out a batch's own partition if a compacted one lists the batch: a crash
    in between never shows rows twice. A batch that was compacted before it
    is replayed is skipped for the same reason.

    One writer compacts at a time; others may append meanwhile.
    """

    LEDGER = (("run_id", "string"), ("batch_id", "bigint"), ("part", "string"))
    COMPACTED = "compacted-"

    def __init__(self, spark: SparkSession, table: str, columns: Sequence[tuple[str, str]], location: str):
        self.spark, self.table, self.columns, self.location = spark, table, list(columns), location
        if "." in table:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
        fields = ", ".join(f"`{n}` {t}" for n, t in [*self.columns, *self.LEDGER])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet PARTITIONED BY (part) LOCATION '{location}'")
        reconcile_schema(spark, table, self.columns)

    def _write(self, rows: DataFrame, part: Column) -> None:
        """Rows as a partition of their own, replacing it; columns that the table has beside theirs become NULL."""
        fields = [f for f in self.spark.table(self.table).schema.fields if f.name != "part"]
        have = set(rows.columns)
        cells = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        (rows.select(*cells, part.alias("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("part").parquet(self.location))
        self._refresh()

    def _refresh(self) -> None:
        """Let the catalog see the partitions there are now."""
        about = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").where("col_name = 'Partition Provider'").first()
        if about is not None and about["data_type"] == "Catalog":
            self.spark.sql(f"MSCK REPAIR TABLE {self.table} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(self.table)

    def _ledger(self) -> DataFrame:
        """Batches that a compacted partition holds."""
        stored = self.spark.table(self.table)
        return stored.where(F.startswith("part", F.lit(self.COMPACTED))).select("run_id", "batch_id").distinct()

    def append(self, rows: DataFrame, batch_id: int, run_id: str, partitions: int = 0) -> None:
        """Append one batch of a writer (:func:`run_identity`); appended again it replaces itself, or is skipped once compacted."""
        tagged = rows.withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
        fresh = with_file_count(tagged, partitions).join(F.broadcast(self._ledger().where(
            (F.col("run_id") == run_id) & (F.col("batch_id") == int(batch_id)))), ["run_id", "batch_id"], "left_anti")
        self._write(fresh, F.lit(f"{run_id}-{int(batch_id)}"))

    def read(self) -> DataFrame:
        """All rows, each batch once, without the ledger columns."""
        stored = self.spark.table(self.table)
        done = F.startswith("part", F.lit(self.COMPACTED))
        loose = stored.where(~done).join(self._ledger(), ["run_id", "batch_id"], "left_anti")
        names = [f.name for f in stored.schema.fields if f.name not in {n for n, _ in self.LEDGER}]
        return stored.where(done).select(*names).unionByName(loose.select(*names))

    def compact(self, files: int = 1) -> int:
        """Rewrite the loose batches into one partition of ``files`` files; returns how many batches it took.

        Loose partitions that an interrupted compaction left behind are removed too.
        """
        stored = self.spark.table(self.table)
        loose = stored.where(~F.startswith("part", F.lit(self.COMPACTED)))
        # one row a batch since the last run, from partition names alone
        parts = sorted(r["part"] for r in loose.select("part").distinct().collect())
        if not parts:
            return 0
        taken = loose.where(F.col("part").isin(parts)).join(self._ledger(), ["run_id", "batch_id"], "left_anti")
        self._write(taken.repartition(files), F.lit(f"{self.COMPACTED}{uuid.uuid4().hex}"))
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.location)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for part in parts:
            fs.delete(jvm.Path(root, f"part={part}"), True)
        self._refresh()
        return len(parts)


def write_prediction_logs(batch: DataFrame, batch_id: int, events_path: str | TableSink, requests_path: str | TableSink,
                          dead_letter_path: str | TableSink, partitions: int = 0, run_id: str | None = None) -> None:
    """S11 + ST4: one scored batch appended to the events and requests tables, rejects to the dead letters.

    Each target is a folder, or a :class:`TableSink` (which needs ``run_id``).

    The batch is persisted once so the three projections do not recompute
    the scoring; it is unpersisted when the writes are done.
    """
    from lendwise.operators.requests import dead_letters, event_log, request_log

    batch.persist()
    try:
        for rows, target in ((event_log(batch), events_path), (request_log(batch), requests_path),
                             (dead_letters(batch), dead_letter_path)):
            if isinstance(target, TableSink):
                target.append(rows, batch_id, run_id, partitions)
            else:
                append_batch(rows, target, batch_id, partitions, run_id=run_id)
    finally:
        batch.unpersist()

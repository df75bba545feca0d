"""Joins of the lending tables (JN1–JN4, JN6–JN8).

Joins apply only when the key exists on both sides (the reference's
conditional joins); that is decided from the schemas while the plan is
built. NULL keys never match (SQL semantics). The physical strategy is
Catalyst's: it broadcasts a side only when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides
on the key, with AQE re-planning and splitting skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.functions.columns import numeric_columns, rename_collisions
from lendwise.operators.dedup import keep_last


# Largest side (bytes of its values) broadcast after it was measured; beyond it a shuffle join.
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, materialize: bool = True) -> DataFrame:
    """Materialise a fitted lookup table once, measure it, broadcast it only if small.

    For tables whose size is the cardinality of a key rather than the data
    size (category dictionaries, per-group statistics). The table is
    checkpointed first (it is a fitted artefact; computing it once serves
    both the measure and the join). The measure is in bytes: 16 a value, and
    the length of every text. Beyond ``max_bytes`` Catalyst/AQE choose a
    shuffle join instead. ``materialize=False`` skips the checkpoint when
    the table is a cheap aggregate of data that is already checkpointed.
    """
    from lendwise.session import ensure_checkpoint_dir

    fitted = small
    if materialize:
        ensure_checkpoint_dir(small.sparkSession)
        fitted = small.checkpoint(eager=True)
    size = F.lit(16 * len(fitted.columns))
    for f in fitted.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
    held = fitted.agg(F.sum(size.cast("bigint")).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(fitted) if held <= max_bytes else fitted


# A key that holds one in this many rows, or more, is hot; there are no more hot keys than that.
HOT_SHARE = 1000
HOT_PARTS = 64


def split_left_join(left: DataFrame, right: DataFrame, key: str, hot_share: int = HOT_SHARE, parts: int = HOT_PARTS) -> DataFrame:
    """``left`` ⟕ ``right`` on ``key`` where single keys may hold much of ``left`` (a missing client's id, say).

    One aggregate counts the keys of ``left``; those with at least one in
    ``hot_share`` of all rows — at most ``hot_share`` keys, so they are
    broadcast — are dealt over ``parts`` buckets by a hash of the row, and
    their rows of ``right`` are repeated in every bucket. All other rows
    stay in bucket 0. A NULL key, which never matches, is dealt too. Rows,
    columns and order of columns are those of the plain left join. The
    bucket follows from the row alone, so a lost task is made again alike;
    rows that are equal in every column share one.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("t")).select("t").scalar()
    hot = F.broadcast(counts.where(F.col(key).isNotNull() & (F.col("__n") * hot_share >= total)).select(F.col(key).alias("__hot")))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(parts))
    dealt = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn(
        "__part", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), spread).otherwise(F.lit(0).cast("bigint"))).drop("__hot")
    copies = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn(
        "__part", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
                            .otherwise(F.array(F.lit(0).cast("bigint"))))).drop("__hot")
    return dealt.join(copies, [key, "__part"], "left").drop("__part")


def _left_join(left: DataFrame, right: DataFrame, key: str, split_hot: bool) -> DataFrame:
    return split_left_join(left, right, key) if split_hot else left.join(right, key, "left")


def left_join_labels(frame: DataFrame, labels: DataFrame, key: str = "id_contrato") -> DataFrame:
    """JN7: training rows with the label columns they lack; rows without a label keep NULL."""
    new = [c for c in labels.columns if c != key and c not in frame.columns]
    return frame.join(labels.select(key, *new), key, "left")


def left_join_if_keyed(left: DataFrame, right: DataFrame | None, key: str, suffix: str | None = None,
                       split_hot: bool = False) -> DataFrame:
    """JN2: left join when both sides carry ``key``; otherwise ``left`` unchanged.

    Right-side duplicates fan out (the profile is not deduplicated); right
    columns colliding with the left get ``suffix`` (default ``_y``).
    ``split_hot`` deals hot keys over many tasks (:func:`split_left_join`).
    """
    if right is None or key not in left.columns or key not in right.columns:
        return left
    right = rename_collisions(right, left.columns, key, suffix or "_y")
    return _left_join(left, right, key, split_hot)


def left_join_new_columns(left: DataFrame, right: DataFrame | None, key: str) -> DataFrame:
    """JN3: left join taking only right columns that ``left`` lacks."""
    if right is None or key not in left.columns or key not in right.columns:
        return left
    extra = [c for c in right.columns if c != key and c not in left.columns]
    return left.join(right.select(key, *extra), key, "left")


def left_join_latest(left: DataFrame, right: DataFrame | None, key: str, order: Sequence[str],
                     suffix: str = "_submissao", split_hot: bool = False) -> DataFrame:
    """JN4: left join of the latest right row per key, colliding columns suffixed; ``split_hot`` as in JN2."""
    if right is None or key not in left.columns or key not in right.columns:
        return left
    latest = keep_last(right, key, order)
    return _left_join(left, rename_collisions(latest, left.columns, key, suffix), key, split_hot)


def numeric_means(df: DataFrame, key: str, suffix: str = "_parcelas_mean") -> DataFrame:
    """Mean of every numeric column per ``key``, named ``{col}{suffix}``."""
    cols = [c for c in numeric_columns(df) if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.avg(F.col(c)).alias(f"{c}{suffix}") for c in cols]
    )


def left_join_means(left: DataFrame, detail: DataFrame | None, key: str, suffix: str = "_parcelas_mean") -> DataFrame:
    """JN6: aggregate ``detail`` to one row per key first (no fan-out), then left join."""
    if detail is None or key not in left.columns or key not in detail.columns:
        return left
    if not [c for c in numeric_columns(detail) if c != key]:
        return left
    return left.join(numeric_means(detail, key, suffix), key, "left")

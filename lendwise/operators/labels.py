"""Delinquency labels from instalments (A1–A5, JN5).

One conditional aggregation per contract computes all three flags in a single
scan and a single shuffle on the contract id; there is no three-way outer
join of separate label tables. When the instalments are already
hash-partitioned on the contract id (e.g. they come out of a join on it), the
aggregation reuses that partitioning and adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwise.functions.dates import UNPAID_DAYS, date_of, days_late

# Label names, horizons and thresholds of the three targets.
FPD = "target_fpd"
EVER30 = "target_ever30mob03"
OVER60 = "target_over60mob06"
EVER30_MAX_PARCELA = 3
EVER30_DAYS = 30
OVER60_MAX_PARCELA = 6
OVER60_DAYS = 60
FPD_DAYS = 1


def with_lateness(
    instalments: DataFrame,
    paid: str = "data_real_pagamento",
    due: str = "data_prevista_pagamento",
    out: str = "atraso",
    unpaid_days: int = UNPAID_DAYS,
) -> DataFrame:
    """P1 + P3 + P4: lenient date parse, days late, unpaid → ``unpaid_days``."""
    raw = days_late(date_of(instalments, paid), date_of(instalments, due))
    return instalments.withColumn(out, F.coalesce(raw, F.lit(unpaid_days)))


def _late(df: DataFrame, paid: str, due: str) -> Column:
    return days_late(date_of(df, paid), date_of(df, due))


def ever30_expr(n: Column, late: Column, max_parcela: int = EVER30_MAX_PARCELA, days: int = EVER30_DAYS) -> Column:
    """A1 aggregate: max lateness over instalments ≤ ``max_parcela`` is above ``days``."""
    return F.coalesce(F.max(F.when(n <= max_parcela, late)) > days, F.lit(False)).cast("int")


def over60_expr(n: Column, late: Column, max_parcela: int = OVER60_MAX_PARCELA, days: int = OVER60_DAYS) -> Column:
    """A2 aggregate: sum of positive lateness over instalments ≤ ``max_parcela`` is above ``days``."""
    pos = F.when((n <= max_parcela) & (late > 0), late)
    return (F.coalesce(F.sum(pos), F.lit(0)) > days).cast("int")


def fpd_expr(n: Column, raw_late: Column, days: int = FPD_DAYS) -> Column:
    """A3 aggregate: first instalment more than ``days`` late or unpaid.

    ``max`` over duplicated first instalments is order-free (the reference
    keeps the first row in file order).
    """
    flag = F.when(n == 1, ((raw_late > days) | raw_late.isNull()).cast("int"))
    return F.coalesce(F.max(flag), F.lit(0)).cast("int")


def contract_labels(
    instalments: DataFrame,
    contract: str = "id_contrato",
    parcela: str = "numero_parcela",
    paid: str = "data_real_pagamento",
    due: str = "data_prevista_pagamento",
    fpd_days: int = FPD_DAYS,
    unpaid_days: int = UNPAID_DAYS,
) -> DataFrame:
    """A4: one row per contract that has an instalment ≤ 6, with the three 0/1 flags.

    Equivalent to the outer join of the three per-label tables followed by
    ``fillna(0)``: the contract set of A1 and A3 is contained in A2's.
    NULL contract ids are dropped, as a pandas group-by does.
    """
    n = F.col(parcela)
    raw = _late(instalments, paid, due)
    late = F.coalesce(raw, F.lit(unpaid_days))
    base = instalments.where(F.col(contract).isNotNull() & (n <= OVER60_MAX_PARCELA))
    return base.groupBy(contract).agg(
        fpd_expr(n, raw, fpd_days).alias(FPD),
        ever30_expr(n, late).alias(EVER30),
        over60_expr(n, late).alias(OVER60),
    )


def ever30_labels(instalments: DataFrame, contract: str = "id_contrato", parcela: str = "numero_parcela",
                  paid: str = "data_real_pagamento", due: str = "data_prevista_pagamento") -> DataFrame:
    """A1 alone: contracts with an instalment ≤ 3 and their EVER30MOB03 flag."""
    n = F.col(parcela)
    late = F.coalesce(_late(instalments, paid, due), F.lit(UNPAID_DAYS))
    base = instalments.where(F.col(contract).isNotNull() & (n <= EVER30_MAX_PARCELA))
    return base.groupBy(contract).agg(ever30_expr(n, late).alias(EVER30))


def over60_labels(instalments: DataFrame, contract: str = "id_contrato", parcela: str = "numero_parcela",
                  paid: str = "data_real_pagamento", due: str = "data_prevista_pagamento") -> DataFrame:
    """A2 alone: contracts with an instalment ≤ 6 and their OVER60MOB06 flag."""
    n = F.col(parcela)
    late = F.coalesce(_late(instalments, paid, due), F.lit(UNPAID_DAYS))
    base = instalments.where(F.col(contract).isNotNull() & (n <= OVER60_MAX_PARCELA))
    return base.groupBy(contract).agg(over60_expr(n, late).alias(OVER60))


def fpd_labels(instalments: DataFrame, contract: str = "id_contrato", parcela: str = "numero_parcela",
               paid: str = "data_real_pagamento", due: str = "data_prevista_pagamento",
               days: int = FPD_DAYS) -> DataFrame:
    """A3 alone: contracts with a first instalment and their FPD flag."""
    n = F.col(parcela)
    base = instalments.where(F.col(contract).isNotNull() & (n == 1))
    return base.groupBy(contract).agg(fpd_expr(n, _late(instalments, paid, due), days).alias(FPD))


def outer_join_labels(*tables: DataFrame, key: str = "id_contrato") -> DataFrame:
    """JN5: full outer join of per-label tables on ``key``, missing flags → 0."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, "full_outer")
    flags = [c for c in out.columns if c != key]
    return out.select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in flags])


def bad_rate_summary(labelled: DataFrame, by: list[str] | None = None,
                     flags: tuple[str, ...] = (FPD, EVER30, OVER60), key: str = "id_contrato") -> DataFrame:
    """A5: per group, the mean and sum of each flag and the contract count."""
    aggs = [F.count(F.col(key)).alias("n_contracts")]
    for f in flags:
        aggs.append(F.avg(F.col(f).cast("double")).alias(f"{f}_rate"))
        aggs.append(F.sum(F.col(f).cast("bigint")).alias(f"{f}_sum"))
    grouped = labelled.groupBy(*by) if by else labelled.groupBy()
    return grouped.agg(*aggs)

"""A1–A5 on hand-written instalment edge cases (FIXTURES.md §2, instalment_edges)."""

from lendwise.operators import labels as L

ROWS = [
    # id, parcela, due, paid
    (1, 1, "2024-01-10", None),            # unpaid first instalment → FPD, 999 late
    (2, 1, "2024-01-10", "2024-01-11"),    # exactly 1 day late → no FPD
    (3, 1, "2024-01-10", "2024-01-12"),    # 2 days → FPD
    (4, 2, "2024-01-10", "2024-02-09"),    # 30 days → not EVER30
    (5, 2, "2024-01-10", "2024-02-10"),    # 31 days → EVER30
    (6, 4, "2024-01-10", "2024-03-10"),    # 60 days in parcela 4 → over60 sum 60 → 0
    (7, 4, "2024-01-10", "2024-03-11"),    # 61 → OVER60, not EVER30 (parcela 4)
    (8, 1, "2024-01-10", "2024-01-01"),    # early payment only
    (9, 7, "2024-01-10", None),            # only parcela ≥ 7 → no label row
    (10, 1, "2024-01-10", "2024-01-10"),   # duplicate parcela 1: on time …
    (10, 1, "2024-01-10", "2024-01-20"),   # … and 10 days late → FPD by max
    (None, 1, "2024-01-10", None),         # null id dropped
    (11, None, "2024-01-10", None),        # null parcela → excluded
    (12, 1, "2024-01-10", "not a date"),   # unparsable paid → treated as unpaid
    (13, 3, "2024-01-10", "2024-02-10"),   # 31 days at parcela 3 → EVER30
    (13, 5, "2024-01-10", "2024-01-31"),   # +21 → over60 sum 52 → 0
]


def _frame(spark):
    return spark.createDataFrame(
        ROWS, "id_contrato bigint, numero_parcela int, data_prevista_pagamento string, data_real_pagamento string"
    )


def test_contract_labels(spark):
    got = {r["id_contrato"]: (r[L.FPD], r[L.EVER30], r[L.OVER60]) for r in L.contract_labels(_frame(spark)).collect()}
    assert got == {
        1: (1, 1, 1),
        2: (0, 0, 0),
        3: (1, 0, 0),
        4: (0, 0, 0),
        5: (0, 1, 0),
        6: (0, 0, 0),
        7: (0, 0, 1),
        8: (0, 0, 0),
        10: (1, 0, 0),
        12: (1, 1, 1),
        13: (0, 1, 0),
    }


def test_separate_tables_and_outer_join_agree(spark):
    df = _frame(spark)
    joined = L.outer_join_labels(L.ever30_labels(df), L.over60_labels(df), L.fpd_labels(df))
    a = sorted(tuple(r) for r in joined.select("id_contrato", L.FPD, L.EVER30, L.OVER60).collect())
    b = sorted(tuple(r) for r in L.contract_labels(df).select("id_contrato", L.FPD, L.EVER30, L.OVER60).collect())
    assert a == b


def test_fpd_threshold_parameter(spark):
    got = {r["id_contrato"]: r[L.FPD] for r in L.fpd_labels(_frame(spark), days=15).collect()}
    assert got[3] == 0 and got[1] == 1 and got[10] == 0


def test_bad_rate_summary(spark):
    lab = L.contract_labels(_frame(spark))
    row = L.bad_rate_summary(lab).collect()[0]
    assert row["n_contracts"] == 11
    assert row[f"{L.FPD}_sum"] == 4
    assert abs(row[f"{L.FPD}_rate"] - 4 / 11) < 1e-12

"""DuckDB oracle SQL for the registered queries (same names as ``catalog.QUERIES``).

Each statement inlines the binding views it needs (``bindings.ORACLE_VIEWS``)
and rounds doubles exactly as the Spark side does.
"""

from __future__ import annotations

from lendwise.functions.payload import (
    API_FLOAT_FIELDS,
    API_INT_FIELDS,
    API_OPTIONAL_FIELDS,
    API_REQUIRED_FIELDS,
    REQUEST_FIELDS,
    REQUIRED_FALLBACKS,
    default_text,
)
from lendwise.sources.bindings import with_views

ORACLE: dict[str, str] = {}

LATE = "datediff('day', data_prevista_pagamento, data_real_pagamento)"
LATE_FILLED = f"COALESCE({LATE}, 999)"

LABELS_CTE = (
    "contract_flags",
    f"""
    SELECT id_contrato,
           CAST(COALESCE(MAX(CASE WHEN numero_parcela = 1
                 THEN CAST(({LATE} > 1) OR {LATE} IS NULL AS INTEGER) END), 0) AS INTEGER) AS target_fpd,
           CAST(COALESCE(MAX(CASE WHEN numero_parcela <= 3 THEN {LATE_FILLED} END) > 30, false) AS INTEGER)
             AS target_ever30mob03,
           CAST(COALESCE(SUM(CASE WHEN numero_parcela <= 6 AND {LATE_FILLED} > 0 THEN {LATE_FILLED} END), 0) > 60
             AS INTEGER) AS target_over60mob06
    FROM instalments
    WHERE id_contrato IS NOT NULL AND numero_parcela <= 6
    GROUP BY id_contrato""",
)

ORACLE["bad_rate_by_contract_type"] = with_views(
    """
    SELECT c.tipo_contrato,
           CAST(COUNT(c.id_contrato) AS BIGINT) AS n_contracts,
           ROUND(AVG(CAST(l.target_fpd AS DOUBLE)), 10) AS target_fpd_rate,
           CAST(SUM(l.target_fpd) AS BIGINT) AS target_fpd_sum,
           ROUND(AVG(CAST(l.target_ever30mob03 AS DOUBLE)), 10) AS target_ever30mob03_rate,
           CAST(SUM(l.target_ever30mob03) AS BIGINT) AS target_ever30mob03_sum,
           ROUND(AVG(CAST(l.target_over60mob06 AS DOUBLE)), 10) AS target_over60mob06_rate,
           CAST(SUM(l.target_over60mob06) AS BIGINT) AS target_over60mob06_sum
    FROM contracts c JOIN contract_flags l ON c.id_contrato = l.id_contrato
    GROUP BY c.tipo_contrato""",
    "instalments",
    "contracts",
    ctes=[LABELS_CTE],
)

ORACLE["contract_labels"] = with_views("SELECT * FROM contract_flags", "instalments", ctes=[LABELS_CTE])

ORACLE["labels_left_join"] = with_views(
    """
    SELECT c.id_contrato, c.tipo_contrato, f.target_fpd, f.target_ever30mob03
    FROM contracts c LEFT JOIN (
        SELECT l.* FROM contract_flags l JOIN contracts s ON l.id_contrato = s.id_contrato WHERE s.status_contrato = 'F'
    ) f ON c.id_contrato = f.id_contrato""",
    "instalments", "contracts", ctes=[LABELS_CTE],
)

ORACLE["ever30_labels"] = with_views(
    f"""
    SELECT id_contrato,
           CAST(COALESCE(MAX({LATE_FILLED}) > 30, false) AS INTEGER) AS target_ever30mob03
    FROM instalments WHERE id_contrato IS NOT NULL AND numero_parcela <= 3
    GROUP BY id_contrato""",
    "instalments",
)

ORACLE["over60_labels"] = with_views(
    f"""
    SELECT id_contrato,
           CAST(COALESCE(SUM(CASE WHEN {LATE_FILLED} > 0 THEN {LATE_FILLED} END), 0) > 60 AS INTEGER)
             AS target_over60mob06
    FROM instalments WHERE id_contrato IS NOT NULL AND numero_parcela <= 6
    GROUP BY id_contrato""",
    "instalments",
)

ORACLE["fpd_labels"] = with_views(
    f"""
    SELECT id_contrato,
           CAST(MAX(CAST(({LATE} > 1) OR {LATE} IS NULL AS INTEGER)) AS INTEGER) AS target_fpd
    FROM instalments WHERE id_contrato IS NOT NULL AND numero_parcela = 1
    GROUP BY id_contrato""",
    "instalments",
)

ORACLE["labels_outer_join"] = ORACLE["contract_labels"]

ORACLE["instalment_lateness"] = with_views(
    f"""
    SELECT id_contrato, numero_parcela, data_prevista_pagamento, data_real_pagamento,
           CAST({LATE_FILLED} AS INTEGER) AS atraso
    FROM instalments""",
    "instalments",
)


def _r(expr: str, places: int = 10) -> str:
    return f"ROUND({expr}, {places})"


LATEST_APP_CTE = (
    "latest_app",
    """
    SELECT id_cliente, data_solicitacao, tipo_contrato, valor_credito, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY data_solicitacao DESC, event_id DESC) AS rn
      FROM applications WHERE id_cliente IS NOT NULL) WHERE rn = 1""",
)

CONTRACT_COLS = """c.id_contrato, c.id_cliente, c.data_decisao, c.tipo_contrato, c.status_contrato,
       ROUND(c.valor_credito, 10) AS valor_credito, ROUND(c.valor_solicitado, 10) AS valor_solicitado,
       ROUND(c.valor_bem, 10) AS valor_bem, ROUND(c.valor_parcela, 10) AS valor_parcela, c.hora_solicitacao"""
PROFILE_COLS = """p.tipo_renda, ROUND(p.renda_anual, 10) AS renda_anual, p.qtd_membros_familia, p.possui_carro,
       p.data_nascimento"""

ORACLE["training_set"] = with_views(
    f"""
    SELECT {CONTRACT_COLS}, l.target_fpd, l.target_ever30mob03, l.target_over60mob06, {PROFILE_COLS},
           a.data_solicitacao, a.tipo_contrato AS tipo_contrato_submissao,
           ROUND(a.valor_credito, 10) AS valor_credito_submissao, a.event_id
    FROM contracts c JOIN contract_flags l ON c.id_contrato = l.id_contrato
    LEFT JOIN profile p ON c.id_cliente = p.id_cliente
    LEFT JOIN latest_app a ON c.id_cliente = a.id_cliente""",
    "instalments", "contracts", "profile", "applications",
    ctes=[LABELS_CTE, LATEST_APP_CTE],
)

OVER60_CTE = (
    "over60",
    f"""
    SELECT id_contrato,
           CAST(COALESCE(SUM(CASE WHEN {LATE_FILLED} > 0 THEN {LATE_FILLED} END), 0) > 60 AS INTEGER)
             AS target_over60mob06
    FROM instalments WHERE id_contrato IS NOT NULL AND numero_parcela <= 6
    GROUP BY id_contrato""",
)

ORACLE["notebook_training_set"] = with_views(
    f"""
    SELECT {CONTRACT_COLS}, {PROFILE_COLS}, o.target_over60mob06
    FROM contracts c LEFT JOIN profile p ON c.id_cliente = p.id_cliente
    JOIN over60 o ON c.id_contrato = o.id_contrato""",
    "instalments", "contracts", "profile",
    ctes=[OVER60_CTE],
)

ORACLE["credit_features"] = with_views(
    """
    SELECT ROUND(c.valor_credito, 10) AS valor_credito, ROUND(c.valor_solicitado, 10) AS valor_solicitado,
           ROUND(c.valor_bem, 10) AS valor_bem, ROUND(c.valor_parcela, 10) AS valor_parcela,
           c.hora_solicitacao, o.target_over60mob06,
           CAST(floor(datediff('day', p.data_nascimento, c.data_decisao) / 365.0) AS INTEGER) AS feat_idade,
           ROUND(c.valor_credito / CASE WHEN COALESCE(CASE WHEN c.valor_bem <> 0 THEN c.valor_bem END, c.valor_credito) <> 0
                 THEN COALESCE(CASE WHEN c.valor_bem <> 0 THEN c.valor_bem END, c.valor_credito) END, 10) AS feat_ltv,
           CASE WHEN c.hora_solicitacao < 7 OR c.hora_solicitacao > 21 THEN 1 ELSE 0 END AS feat_hora_pico_fraude,
           CAST(dense_rank() OVER (ORDER BY COALESCE(c.tipo_contrato, 'Missing')) - 1 AS DOUBLE) AS feat_tipo_contrato_enc,
           CAST(dense_rank() OVER (ORDER BY COALESCE(c.status_contrato, 'Missing')) - 1 AS DOUBLE) AS feat_status_contrato_enc
    FROM contracts c LEFT JOIN profile p ON c.id_cliente = p.id_cliente
    JOIN over60 o ON c.id_contrato = o.id_contrato""",
    "instalments", "contracts", "profile",
    ctes=[OVER60_CTE],
)

ORACLE["latest_application"] = with_views(
    "SELECT * FROM latest_app", "applications", ctes=[LATEST_APP_CTE]
)

ORACLE["first_instalment"] = with_views(
    """
    SELECT id_contrato, id_cliente, numero_parcela, data_prevista_pagamento, data_real_pagamento, valor_pago FROM (
      SELECT *, row_number() OVER (PARTITION BY id_contrato
                                   ORDER BY numero_parcela ASC NULLS FIRST, data_prevista_pagamento ASC NULLS FIRST,
                                            data_real_pagamento ASC NULLS FIRST, valor_pago ASC NULLS FIRST) AS rn
      FROM instalments WHERE id_contrato IS NOT NULL) WHERE rn = 1""",
    "instalments",
)

ORACLE["applications_merged"] = with_views(
    """
    SELECT a.id_cliente, a.data_solicitacao, a.tipo_contrato, ROUND(a.valor_credito, 10) AS valor_credito, a.event_id,
           p.tipo_renda, ROUND(p.renda_anual, 10) AS renda_anual, p.qtd_membros_familia, p.possui_carro, p.data_nascimento
    FROM applications a LEFT JOIN profile p ON a.id_cliente = p.id_cliente""",
    "applications", "profile",
)

MEANS_CTE = (
    "inst_means",
    """
    SELECT id_contrato, ROUND(AVG(id_cliente), 6) AS id_cliente_parcelas_mean,
           ROUND(AVG(numero_parcela), 6) AS numero_parcela_parcelas_mean,
           ROUND(AVG(valor_pago), 6) AS valor_pago_parcelas_mean
    FROM instalments WHERE id_contrato IS NOT NULL GROUP BY id_contrato""",
)

ORACLE["contracts_merged"] = with_views(
    """
    SELECT c.id_contrato, c.id_cliente, c.data_decisao, c.tipo_contrato, c.status_contrato,
           ROUND(c.valor_credito, 6) AS valor_credito, ROUND(c.valor_solicitado, 6) AS valor_solicitado,
           ROUND(c.valor_bem, 6) AS valor_bem, ROUND(c.valor_parcela, 6) AS valor_parcela, c.hora_solicitacao,
           p.tipo_renda, ROUND(p.renda_anual, 6) AS renda_anual, p.qtd_membros_familia, p.possui_carro, p.data_nascimento,
           m.id_cliente_parcelas_mean, m.numero_parcela_parcelas_mean, m.valor_pago_parcelas_mean
    FROM contracts c LEFT JOIN profile p ON c.id_cliente = p.id_cliente
    LEFT JOIN inst_means m ON c.id_contrato = m.id_contrato""",
    "contracts", "profile", "instalments",
    ctes=[MEANS_CTE],
)

ORACLE["instalment_means"] = with_views("SELECT * FROM inst_means", "instalments", ctes=[MEANS_CTE])

ORACLE["label_union"] = with_views(
    "SELECT DISTINCT label FROM (SELECT quality AS label FROM scored_labels UNION ALL SELECT toxic FROM scored_labels)",
    "scored_labels",
)

ORACLE["profile_features"] = with_views(
    """
    SELECT id_cliente,
           CASE WHEN possui_carro = 'Y' THEN 1 WHEN possui_carro = 'N' THEN 0 END AS possui_carro_flag,
           CASE WHEN possui_carro = 'Y' THEN 1 WHEN possui_carro = 'N' THEN 0 ELSE 0 END AS feat_possui_carro,
           ROUND(renda_anual / 12.0, 10) AS renda_mensal,
           ROUND(renda_anual / CASE WHEN qtd_membros_familia <> 0 THEN CAST(qtd_membros_familia AS DOUBLE) END, 10)
             AS feat_renda_per_capita,
           CAST(year(DATE '2024-01-01') - year(data_nascimento)
             - CASE WHEN month(DATE '2024-01-01') < month(data_nascimento)
                      OR (month(DATE '2024-01-01') = month(data_nascimento) AND day(DATE '2024-01-01') < day(data_nascimento))
                    THEN 1 ELSE 0 END AS INTEGER) AS idade,
           CAST(year(DATE '2024-01-01') - year(data_nascimento) AS INTEGER) AS idade_por_ano,
           COALESCE(possui_carro, 'Unknown') AS possui_carro_filled
    FROM profile""",
    "profile",
)

ORACLE["contract_features"] = with_views(
    """
    SELECT c.id_contrato,
           ROUND(c.valor_parcela / CASE WHEN p.renda_anual / 12.0 <> 0 THEN p.renda_anual / 12.0 END, 10)
             AS feat_comprometimento_renda,
           CAST(floor(datediff('day', p.data_nascimento, c.data_decisao) / 365.0) AS INTEGER) AS feat_idade,
           ROUND(c.valor_credito / CASE WHEN COALESCE(CASE WHEN c.valor_bem <> 0 THEN c.valor_bem END, c.valor_credito) <> 0
                 THEN COALESCE(CASE WHEN c.valor_bem <> 0 THEN c.valor_bem END, c.valor_credito) END, 10) AS feat_ltv,
           CASE WHEN c.hora_solicitacao < 7 OR c.hora_solicitacao > 21 THEN 1 ELSE 0 END AS feat_hora_pico_fraude,
           ROUND(CASE WHEN c.valor_solicitado <> 0 THEN c.valor_credito / c.valor_solicitado END * 100.0, 10) AS pct_concedido
    FROM contracts c LEFT JOIN profile p ON c.id_cliente = p.id_cliente""",
    "contracts", "profile",
)


# --- profiling -------------------------------------------------------------------------

def _null_pct_sql(view: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS null_pct FROM {view}"
        for c in cols
    )
    return parts


CONTRACT_NAMES = ["id_contrato", "id_cliente", "data_decisao", "tipo_contrato", "status_contrato", "valor_credito",
                  "valor_solicitado", "valor_bem", "valor_parcela", "hora_solicitacao"]
PROFILE_NAMES = ["id_cliente", "tipo_renda", "renda_anual", "qtd_membros_familia", "possui_carro", "data_nascimento"]

ORACLE["contracts_null_pct"] = with_views(_null_pct_sql("contracts", CONTRACT_NAMES), "contracts")
ORACLE["profile_null_pct"] = with_views(_null_pct_sql("profile", PROFILE_NAMES), "profile")

ORACLE["contracts_shape"] = with_views(
    f"""SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, {len(CONTRACT_NAMES)} AS n_columns,
           CAST(COUNT(DISTINCT id_cliente) AS BIGINT) AS n_distinct_ids, CAST(COUNT(id_cliente) AS BIGINT) AS n_ids
    FROM contracts""",
    "contracts",
)


def _value_counts_sql(view: str, col: str) -> str:
    return f"""
    SELECT {col}, CAST(COUNT(*) AS BIGINT) AS count,
           ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS pct
    FROM {view} WHERE {col} IS NOT NULL GROUP BY {col}"""


ORACLE["contract_type_counts"] = with_views(_value_counts_sql("contracts", "tipo_contrato"), "contracts")
ORACLE["term_counts"] = with_views(_value_counts_sql("instalments", "numero_parcela"), "instalments")

ORACLE["profile_value_counts"] = with_views(
    """
    SELECT "column", value, CAST(COUNT(*) AS BIGINT) AS count,
           ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY "column"), 6) AS pct
    FROM (SELECT 'tipo_renda' AS "column", tipo_renda AS value FROM profile
          UNION ALL SELECT 'possui_carro', possui_carro FROM profile
          UNION ALL SELECT 'qtd_membros_familia', CAST(qtd_membros_familia AS VARCHAR) FROM profile)
    WHERE value IS NOT NULL GROUP BY "column", value""",
    "profile",
)


def _describe_sql(view: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG({c}), 6) AS mean,
               ROUND(STDDEV_SAMP({c}), 6) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
               ROUND(QUANTILE_CONT({c}, 0.25), 6) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 6) AS p50,
               ROUND(QUANTILE_CONT({c}, 0.75), 6) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM {view}"""
        for c in cols
    )


ORACLE["describe_amounts"] = with_views(_describe_sql("contracts", ["valor_credito", "valor_parcela", "valor_bem"]),
                                        "contracts")


def _histogram_sql(src: str, col: str, width: float, origin: str | None = None, pad: float = 1.0) -> str:
    lo = origin if origin is not None else f"MIN({col})"
    w = f"{float(width)}::DOUBLE"
    return f"""
    WITH src AS ({src}),
    b AS (SELECT lo, CAST(ceil((hi - lo) / {w}) - 1 AS BIGINT) AS nb
          FROM (SELECT CAST({lo} AS DOUBLE) AS lo, CAST(MAX({col}) AS DOUBLE) + {float(width) * pad}::DOUBLE AS hi
                FROM src)),
    binned AS (SELECT least(CAST(floor((CAST({col} AS DOUBLE) - b.lo) / {w}) AS BIGINT), b.nb - 1) AS bin
               FROM src, b WHERE {col} IS NOT NULL AND CAST({col} AS DOUBLE) >= b.lo
                 AND CAST({col} AS DOUBLE) <= b.lo + b.nb * {w}),
    counts AS (SELECT bin, COUNT(*) AS n FROM binned GROUP BY bin),
    grid AS (SELECT CAST(generate_series AS BIGINT) AS bin FROM b, generate_series(0, b.nb - 1)),
    full_ AS (SELECT g.bin, CAST(COALESCE(c.n, 0) AS BIGINT) AS count FROM grid g LEFT JOIN counts c ON g.bin = c.bin)
    SELECT f.bin, ROUND(b.lo + f.bin * {w}, 6) AS bin_start, ROUND(b.lo + (f.bin + 1) * {w}, 6) AS bin_end, f.count,
           ROUND(CASE WHEN SUM(f.count) OVER () > 0 THEN f.count * 100.0 / SUM(f.count) OVER () END, 6) AS pct
    FROM full_ f, b"""


ORACLE["income_histogram"] = with_views(
    "SELECT * FROM (" + _histogram_sql("SELECT renda_anual FROM profile", "renda_anual", 20000.0) + ")", "profile"
)

ORACLE["instalment_value_histogram"] = with_views(
    "SELECT * FROM (" + _histogram_sql(
        "SELECT valor_parcela FROM contracts WHERE valor_parcela <= (SELECT QUANTILE_CONT(valor_parcela, 0.99) FROM contracts)",
        "valor_parcela", 2000.0, origin="0.0") + ")",
    "contracts",
)

AGE_SQL = """
    SELECT CAST(year(DATE '2024-01-01') - year(data_nascimento)
             - CASE WHEN month(DATE '2024-01-01') < month(data_nascimento)
                      OR (month(DATE '2024-01-01') = month(data_nascimento) AND day(DATE '2024-01-01') < day(data_nascimento))
                    THEN 1 ELSE 0 END AS INTEGER) AS idade FROM profile"""

ORACLE["age_histogram"] = with_views("SELECT * FROM (" + _histogram_sql(AGE_SQL, "idade", 1.0, pad=2.0) + ")",
                                     "profile")

LATENESS_CTE = ("lateness", f"SELECT *, CAST({LATE_FILLED} AS INTEGER) AS atraso FROM instalments")
CLIPPED_CTE = ("clipped", "SELECT * FROM lateness WHERE atraso <= (SELECT QUANTILE_CONT(atraso, 0.99) FROM lateness)")

ORACLE["lateness_equal_bins"] = with_views(
    """
    SELECT bin, ROUND(lo + bin * (hi - lo) / 40.0, 6) AS bin_start, CAST(COUNT(*) AS BIGINT) AS count FROM (
      SELECT least(CAST(CASE WHEN hi - lo > 0 THEN floor((CAST(atraso AS DOUBLE) - lo) / (hi - lo) * 40) ELSE 0 END AS BIGINT), 39)
               AS bin, lo, hi
      FROM clipped, (SELECT CAST(MIN(atraso) AS DOUBLE) AS lo, CAST(MAX(atraso) AS DOUBLE) AS hi FROM clipped)
      WHERE atraso IS NOT NULL)
    GROUP BY bin, lo, hi""",
    "instalments",
    ctes=[LATENESS_CTE, CLIPPED_CTE],
)


def _monthly_sql(view: str, col: str, end: bool) -> str:
    label = "last_day(m.month)" if end else "m.month"
    return f"""
    WITH counts AS (SELECT CAST(date_trunc('month', {col}) AS DATE) AS month, COUNT(*) AS n
                    FROM {view} WHERE {col} IS NOT NULL GROUP BY 1),
    months AS (SELECT CAST(generate_series AS DATE) AS month
               FROM (SELECT MIN(month) AS a, MAX(month) AS b FROM counts), generate_series(a, b, INTERVAL 1 MONTH))
    SELECT CAST({label} AS DATE) AS month, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
    FROM months m LEFT JOIN counts c ON m.month = c.month"""


ORACLE["monthly_decisions"] = with_views("SELECT * FROM (" + _monthly_sql("contracts", "data_decisao", True) + ")",
                                         "contracts")
ORACLE["monthly_payments"] = with_views(
    "SELECT * FROM (" + _monthly_sql("instalments", "data_real_pagamento", False) + ")", "instalments"
)

ORACLE["goods_value_null_fraction"] = with_views(
    "SELECT AVG(CASE WHEN valor_bem IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction FROM contracts", "contracts"
)

ORACLE["paid_early_fraction"] = with_views(
    """SELECT AVG(CASE WHEN COALESCE(data_real_pagamento < data_prevista_pagamento, false) THEN 1.0 ELSE 0.0 END)
         AS fraction FROM instalments""",
    "instalments",
)

ORACLE["credit_by_contract_type"] = with_views(
    """SELECT tipo_contrato, CAST(COUNT(id_contrato) AS BIGINT) AS quantidade,
              ROUND(QUANTILE_CONT(valor_credito, 0.5), 6) AS valor_mediano
       FROM contracts GROUP BY tipo_contrato""",
    "contracts",
)


def _box_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    join = " AND ".join(f"s.{x} = q.{x}" for x in keys) or "TRUE"
    sk = ", ".join(f"s.{x}" for x in keys)
    skc = (sk + ", ") if keys else ""
    return f"""
    WITH s AS ({src}),
    q AS (SELECT {kc}QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.5) AS median, QUANTILE_CONT(x, 0.75) AS q3
          FROM s {"GROUP BY " + k if keys else ""}),
    j AS (SELECT {skc}s.x, q.q1, q.median, q.q3,
                 (s.x >= q.q1 - 1.5 * (q.q3 - q.q1) AND s.x <= q.q3 + 1.5 * (q.q3 - q.q1)) AS inside
          FROM s JOIN q ON {join})
    SELECT {kc}ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
           ROUND(MIN(CASE WHEN inside THEN x END), 6) AS whisker_low, ROUND(MAX(CASE WHEN inside THEN x END), 6) AS whisker_high,
           CAST(COUNT(CASE WHEN NOT inside THEN 1 END) AS BIGINT) AS n_outliers, CAST(COUNT(*) AS BIGINT) AS n
    FROM j GROUP BY {kc}q1, median, q3"""


ORACLE["credit_box_by_type"] = with_views(
    "SELECT * FROM (" + _box_sql("SELECT tipo_contrato, CAST(valor_credito AS DOUBLE) AS x FROM contracts WHERE valor_credito IS NOT NULL",
                                 ["tipo_contrato"]) + ")",
    "contracts",
)
ORACLE["lateness_box"] = with_views(
    "SELECT * FROM (" + _box_sql("SELECT CAST(atraso AS DOUBLE) AS x FROM lateness WHERE atraso IS NOT NULL", []) + ")",
    "instalments",
    ctes=[LATENESS_CTE],
)

ORACLE["lateness_summary"] = with_views(
    """SELECT CAST(COUNT(*) AS BIGINT) AS total,
              CAST(COUNT(CASE WHEN NOT (atraso > 0) OR atraso IS NULL THEN 1 END) AS BIGINT) AS em_dia,
              CAST(COUNT(CASE WHEN atraso > 0 THEN 1 END) AS BIGINT) AS atrasados,
              ROUND(COUNT(CASE WHEN atraso > 0 THEN 1 END) * 100.0 / COUNT(*), 6) AS taxa_atraso,
              ROUND(AVG(CAST(atraso AS DOUBLE)), 6) AS media, ROUND(QUANTILE_CONT(CAST(atraso AS DOUBLE), 0.5), 6) AS mediana
       FROM lateness""",
    "instalments",
    ctes=[LATENESS_CTE],
)

ORACLE["contract_status_values"] = with_views("SELECT DISTINCT status_contrato FROM contracts", "contracts")

ORACLE["profile_missingness"] = with_views(
    """SELECT concat(""" + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in PROFILE_NAMES) + """) AS pattern,
              CAST(COUNT(*) AS BIGINT) AS count
       FROM profile GROUP BY 1""",
    "profile",
)

ORACLE["lateness_kde"] = with_views(
    """
    SELECT g.i AS grid_index, ROUND(st.g0 + g.i * st.step, 6) AS x,
           ROUND(SUM(v.w * exp(-0.5 * ((st.g0 + g.i * st.step - v.v) / st.h) * ((st.g0 + g.i * st.step - v.v) / st.h)))
                 / (st.n * st.h * sqrt(2 * pi())), 12) AS density
    FROM (SELECT CAST(atraso AS DOUBLE) AS v, COUNT(*) AS w FROM clipped WHERE atraso IS NOT NULL GROUP BY 1) v,
         (SELECT n, h, lo AS g0, (hi - lo) / 199.0 AS step FROM (
             SELECT COUNT(atraso) AS n, STDDEV_SAMP(atraso) * pow(CAST(COUNT(atraso) AS DOUBLE), -0.2) AS h,
                    CAST(MIN(atraso) AS DOUBLE) AS lo, CAST(MAX(atraso) AS DOUBLE) AS hi FROM clipped)) st,
         (SELECT CAST(generate_series AS INTEGER) AS i FROM generate_series(0, 199)) g
    GROUP BY g.i, st.g0, st.step, st.n, st.h""",
    "instalments",
    ctes=[LATENESS_CTE, CLIPPED_CTE],
)

ORACLE["top_clients"] = with_views(
    """SELECT id_cliente, CAST(COUNT(*) AS BIGINT) AS count,
              ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM contracts), 6) AS pct
       FROM contracts WHERE id_cliente IS NOT NULL GROUP BY id_cliente
       ORDER BY count DESC, id_cliente ASC LIMIT 20""",
    "contracts",
)

ORACLE["complete_profiles"] = with_views(
    """SELECT id_cliente, tipo_renda, ROUND(renda_anual, 10) AS renda_anual, qtd_membros_familia, possui_carro,
              data_nascimento FROM profile WHERE renda_anual IS NOT NULL AND possui_carro IS NOT NULL""",
    "profile",
)

ORACLE["contracts_head"] = with_views(
    f"SELECT {CONTRACT_COLS} FROM contracts c ORDER BY c.id_contrato LIMIT 5", "contracts"
)

ORACLE["predictions_first_n"] = with_views(
    """SELECT event_id, event_ts, ROUND(probability, 10) AS probability, event_type, target, id_cliente
       FROM predictions ORDER BY event_ts, event_id LIMIT 1000""",
    "predictions",
)

ORACLE["income_median_fill"] = with_views(
    """SELECT id_cliente, tipo_renda,
              ROUND(COALESCE(renda_anual, (SELECT QUANTILE_CONT(renda_anual, 0.5) FROM profile)), 10) AS renda_anual,
              qtd_membros_familia, possui_carro, data_nascimento FROM profile""",
    "profile",
)

ORACLE["income_clip_p99"] = with_views(
    """SELECT id_cliente, tipo_renda, ROUND(renda_anual, 10) AS renda_anual, qtd_membros_familia, possui_carro,
              data_nascimento FROM profile
       WHERE renda_anual <= (SELECT QUANTILE_CONT(renda_anual, 0.99) FROM profile)""",
    "profile",
)


# --- metrics and monitoring ---------------------------------------------------------------

def _auc_sql(src: str, label: str, score: str, keys: list[str] | None = None, places: int = 10) -> str:
    keys = keys or []
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    return f"""
    SELECT {kc}ROUND(CASE WHEN SUM(p) > 0 AND SUM(n) > 0
                      THEN SUM(p * (below + n / 2.0)) / (CAST(SUM(p) AS DOUBLE) * CAST(SUM(n) AS DOUBLE)) END, {places}) AS auc,
           CAST(SUM(p) AS BIGINT) AS n_pos, CAST(SUM(n) AS BIGINT) AS n_neg
    FROM (SELECT {kc}s, p, n,
                 COALESCE(SUM(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM (SELECT {kc}CAST({score} AS DOUBLE) AS s,
                       SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS p,
                       SUM(CASE WHEN {label} <> 1 THEN 1 ELSE 0 END) AS n
                FROM ({src}) WHERE {label} IS NOT NULL AND {score} IS NOT NULL
                GROUP BY {kc}CAST({score} AS DOUBLE)))
    {"GROUP BY " + k if keys else ""}"""


ORACLE["auc_scored_labels"] = with_views(
    f"""SELECT 'quality' AS target, * FROM ({_auc_sql('SELECT * FROM scored_labels', 'quality', 'score')})
        UNION ALL
        SELECT 'toxic' AS target, * FROM ({_auc_sql('SELECT * FROM scored_labels', 'toxic', 'score')})""",
    "scored_labels",
)

ORACLE["auc_by_lang"] = with_views(_auc_sql("SELECT * FROM scored_labels", "quality", "score", ["lang"]), "scored_labels")

ORACLE["auc_predictions"] = with_views(_auc_sql("SELECT * FROM predictions", "target", "probability"), "predictions")

ORACLE["class_report_05"] = with_views(
    """
    WITH b AS (SELECT target AS y, CAST(probability > 0.5 AS INTEGER) AS p FROM predictions
               WHERE target IS NOT NULL AND probability IS NOT NULL),
    c AS (SELECT cls, SUM(tp) AS tp, SUM(pr) AS n_pred, SUM(ac) AS support FROM (
            SELECT y AS cls, CAST(y = p AS INTEGER) AS tp, 0 AS pr, 1 AS ac FROM b
            UNION ALL SELECT p, 0, 1, 0 FROM b) GROUP BY cls),
    m AS (SELECT cls, COALESCE(CASE WHEN n_pred <> 0 THEN tp * 1.0 / n_pred END, 0.0) AS prec,
                 COALESCE(CASE WHEN support <> 0 THEN tp * 1.0 / support END, 0.0) AS rec, support FROM c)
    SELECT cls AS class, ROUND(prec, 10) AS precision, ROUND(rec, 10) AS recall,
           ROUND(COALESCE(CASE WHEN prec + rec <> 0 THEN 2.0 * prec * rec / (prec + rec) END, 0.0), 10) AS f1,
           CAST(support AS BIGINT) AS support
    FROM m""",
    "predictions",
)

ORACLE["confusion_03"] = with_views(
    """
    WITH b AS (SELECT CAST(target AS INTEGER) AS y, CAST(probability > 0.3 AS INTEGER) AS p FROM predictions
               WHERE target IS NOT NULL AND probability IS NOT NULL),
    cells AS (SELECT a.a AS actual, pp.b AS predicted FROM (VALUES (0), (1)) a(a), (VALUES (0), (1)) pp(b))
    SELECT c.actual, c.predicted, CAST(COUNT(b.y) AS BIGINT) AS count
    FROM cells c LEFT JOIN b ON b.y = c.actual AND b.p = c.predicted
    GROUP BY c.actual, c.predicted""",
    "predictions",
)

ORACLE["threshold_sweep"] = with_views(
    """
    WITH t AS (SELECT * FROM (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(threshold)),
    c AS (SELECT t.threshold,
                 COUNT(CASE WHEN y = 0 AND s < t.threshold THEN 1 END) AS c00,
                 COUNT(CASE WHEN y = 0 AND s >= t.threshold THEN 1 END) AS c01,
                 COUNT(CASE WHEN y = 1 AND s < t.threshold THEN 1 END) AS c10,
                 COUNT(CASE WHEN y = 1 AND s >= t.threshold THEN 1 END) AS c11
          FROM (SELECT CAST(target AS INTEGER) AS y, probability AS s FROM predictions
                WHERE target IS NOT NULL AND probability IS NOT NULL) b, t
          GROUP BY t.threshold),
    k AS (SELECT threshold, 0 AS class, c00 AS tp, c10 AS fp, c01 AS fn, c00 + c01 + c10 + c11 AS total, c00 + c11 AS ok FROM c
          UNION ALL
          SELECT threshold, 1, c11, c01, c10, c00 + c01 + c10 + c11, c00 + c11 FROM c),
    m AS (SELECT *, COALESCE(CASE WHEN tp + fp <> 0 THEN tp * 1.0 / (tp + fp) END, 0.0) AS prec,
                    COALESCE(CASE WHEN tp + fn <> 0 THEN tp * 1.0 / (tp + fn) END, 0.0) AS rec FROM k)
    SELECT threshold, class, ROUND(prec, 10) AS precision, ROUND(rec, 10) AS recall,
           ROUND(COALESCE(CASE WHEN prec + rec <> 0 THEN 2.0 * prec * rec / (prec + rec) END, 0.0), 10) AS f1,
           CAST(tp + fn AS BIGINT) AS support,
           ROUND(COALESCE(CASE WHEN total <> 0 THEN ok * 1.0 / total END, 0.0), 10) AS accuracy
    FROM m""",
    "predictions",
)

RUNS_CTE = (
    "runs",
    f"""
    SELECT lang AS model, version,
           CASE WHEN version % 7 = 0 THEN 'Production' ELSE 'None' END AS stage, auc AS valid_auc
    FROM ({_auc_sql("SELECT *, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS version FROM scored_labels",
                    "quality", "score", ["lang", "version"], places=17)})""",
)

CHAMPION_CTE = (
    "champ",
    """
    SELECT model, version AS champion_version, stage AS champion_stage, valid_auc AS champion_auc FROM (
      SELECT *, row_number() OVER (PARTITION BY model
                                   ORDER BY CASE WHEN stage = 'Production' THEN 1 ELSE 0 END DESC, version DESC) AS rn
      FROM runs WHERE version IS NOT NULL) WHERE rn = 1""",
)

ORACLE["champion_runs"] = with_views(
    """SELECT model, CAST(champion_version AS BIGINT) AS champion_version, champion_stage,
              ROUND(champion_auc, 10) AS champion_auc FROM champ""",
    "scored_labels", ctes=[RUNS_CTE, CHAMPION_CTE],
)

ORACLE["promotion_gate"] = with_views(
    f"""
    SELECT c.model, ROUND(c.new_auc, 10) AS new_auc, CAST(h.champion_version AS BIGINT) AS champion_version,
           h.champion_stage, ROUND(h.champion_auc, 10) AS champion_auc,
           CASE WHEN c.new_auc < 0.4 THEN false WHEN h.champion_auc IS NULL THEN true
                WHEN c.new_auc < h.champion_auc - 0.005 THEN false ELSE true END AS passed,
           CASE WHEN c.new_auc < 0.4 THEN 'below minimum valid_auc' WHEN h.champion_auc IS NULL THEN 'no champion'
                WHEN c.new_auc < h.champion_auc - 0.005 THEN 'below champion floor' ELSE 'passed vs champion' END AS reason
    FROM (SELECT lang AS model, auc AS new_auc FROM ({_auc_sql('SELECT * FROM scored_labels', 'quality', 'score', ['lang'], places=17)})) c
    LEFT JOIN champ h ON c.model = h.model""",
    "scored_labels", ctes=[RUNS_CTE, CHAMPION_CTE],
)

ORACLE["event_chunks"] = with_views(
    """SELECT event_id, event_ts, CAST(floor((row_number() OVER (ORDER BY event_ts, event_id) - 1) / 500) AS BIGINT) AS chunk
       FROM predictions""",
    "predictions",
)

DRIFT_CTES = [
    ("ref", "SELECT * FROM monitoring WHERE is_reference"),
    ("ana", """SELECT *, CAST(floor((row_number() OVER (ORDER BY event_ts, event_id) - 1) / 500) AS BIGINT) AS chunk
               FROM monitoring WHERE NOT is_reference"""),
    ("ref_long", """SELECT 'value' AS feature, CAST(value AS DOUBLE) AS num, NULL::VARCHAR AS cat FROM ref
                    UNION ALL SELECT 'event_type', NULL::DOUBLE, event_type FROM ref
                    UNION ALL SELECT 'hora', CAST(hora AS DOUBLE), NULL::VARCHAR FROM ref"""),
    ("ana_long", """SELECT chunk, 'value' AS feature, CAST(value AS DOUBLE) AS num, NULL::VARCHAR AS cat FROM ana
                    UNION ALL SELECT chunk, 'event_type', NULL::DOUBLE, event_type FROM ana
                    UNION ALL SELECT chunk, 'hora', CAST(hora AS DOUBLE), NULL::VARCHAR FROM ana"""),
    ("rng", "SELECT feature, MIN(num) AS lo, MAX(num) AS hi FROM ref_long GROUP BY feature"),
    ("ref_b", """SELECT r.feature, CASE WHEN cat IS NOT NULL THEN cat WHEN num IS NOT NULL THEN CAST(greatest(0, least(
                   CAST(CASE WHEN hi - lo > 0 THEN floor((num - lo) / (hi - lo) * 10) ELSE 0 END AS BIGINT), 9)) AS VARCHAR)
                   ELSE '__null__' END AS bin FROM ref_long r JOIN rng g ON r.feature = g.feature"""),
    ("p", """SELECT feature, bin, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY feature) AS p
             FROM ref_b GROUP BY feature, bin"""),
    ("ana_b", """SELECT a.chunk, a.feature, CASE WHEN cat IS NOT NULL THEN cat WHEN num IS NOT NULL THEN CAST(greatest(0, least(
                   CAST(CASE WHEN hi - lo > 0 THEN floor((num - lo) / (hi - lo) * 10) ELSE 0 END AS BIGINT), 9)) AS VARCHAR)
                   ELSE '__null__' END AS bin FROM ana_long a JOIN rng g ON a.feature = g.feature"""),
    ("q", """SELECT feature, chunk, bin, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY feature, chunk) AS q
             FROM ana_b GROUP BY feature, chunk, bin"""),
    ("js", """SELECT feature, chunk, ROUND(sqrt(greatest(SUM(
                  CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2.0)) ELSE 0.0 END
                + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2.0)) ELSE 0.0 END) + 0.5 * (1.0 - SUM(p)), 0.0)), 9)
                AS js_distance
             FROM (SELECT q.feature, q.chunk, q.q, COALESCE(p.p, 0.0) AS p FROM q LEFT JOIN p ON q.feature = p.feature AND q.bin = p.bin)
             GROUP BY feature, chunk"""),
    ("drift", "SELECT feature, chunk, js_distance, js_distance > 0.1 AS alert FROM js"),
    ("drift_sum", """SELECT CAST(SUM(CAST(alert AS INTEGER)) AS BIGINT) AS n_alerts, AVG(CAST(alert AS DOUBLE)) AS alert_rate,
                     AVG(CAST(alert AS DOUBLE)) >= 0.7 AS drift_detected FROM drift"""),
]

ORACLE["univariate_drift"] = with_views("SELECT * FROM drift", "monitoring", ctes=DRIFT_CTES)
ORACLE["drift_alert_summary"] = with_views(
    "SELECT n_alerts, ROUND(alert_rate, 10) AS alert_rate, drift_detected FROM drift_sum", "monitoring", ctes=DRIFT_CTES
)

DECAY_CTES = [
    ("ref_auc", _auc_sql("SELECT * FROM monitoring WHERE is_reference", "target", "probability", places=17)),
    ("ana_auc", _auc_sql("SELECT * FROM monitoring WHERE NOT is_reference", "target", "probability", places=17)),
    ("decay", """SELECT true AS decay_checked, r.auc AS reference_auc, a.auc AS analysis_auc, r.auc - a.auc AS auc_drop,
                 COALESCE(r.auc - a.auc >= 0.03, false) AS decay_detected FROM ref_auc r, ana_auc a"""),
]

ORACLE["auc_decay"] = with_views(
    """SELECT decay_checked, ROUND(reference_auc, 10) AS reference_auc, ROUND(analysis_auc, 10) AS analysis_auc,
              ROUND(auc_drop, 10) AS auc_drop, decay_detected FROM decay""",
    "monitoring", ctes=DECAY_CTES,
)


def _denied_sql(threshold: float, offset: int) -> str:
    return f"""
    SELECT negado_count, negado_denominator,
           CASE WHEN negado_denominator > 0 THEN negado_count * 1.0 / negado_denominator END AS negado_fraction,
           COALESCE(CASE WHEN negado_denominator > 0 THEN negado_count * 1.0 / negado_denominator END < 0.9, false)
             AS negado_below_threshold_retrain
    FROM (SELECT CAST(COUNT(CASE WHEN TRY_CAST(probability AS DOUBLE) >= {threshold} THEN 1 END) AS BIGINT) AS negado_count,
                 CAST(COUNT(TRY_CAST(probability AS DOUBLE)) + {offset} AS BIGINT) AS negado_denominator
          FROM predictions)"""


DENIED_CTE = ("denied", _denied_sql(0.5, 0))
MEAN_CTE = ("mscore", """SELECT AVG(TRY_CAST(probability AS DOUBLE)) AS probability_avg,
                                COALESCE(AVG(TRY_CAST(probability AS DOUBLE)) > 0.2, false) AS probability_above_threshold_retrain
                         FROM predictions""")

ORACLE["denied_rate"] = with_views(
    """SELECT negado_count, negado_denominator, ROUND(negado_fraction, 10) AS negado_fraction,
              negado_below_threshold_retrain FROM denied""", "predictions", ctes=[DENIED_CTE])
ORACLE["denied_rate_as_coded"] = with_views(
    """SELECT negado_count, negado_denominator, ROUND(negado_fraction, 10) AS negado_fraction,
              negado_below_threshold_retrain FROM denied""", "predictions", ctes=[("denied", _denied_sql(0.1, 10))])
ORACLE["mean_score"] = with_views(
    "SELECT ROUND(probability_avg, 10) AS probability_avg, probability_above_threshold_retrain FROM mscore",
    "predictions", ctes=[MEAN_CTE])

DECISION_CTE = (
    "decision",
    """SELECT (COALESCE(s.drift_detected, false) OR COALESCE(d.decay_detected, false)
               OR COALESCE(n.negado_below_threshold_retrain, false) OR COALESCE(m.probability_above_threshold_retrain, false))
              AS should_retrain,
              COALESCE(s.n_alerts, 0) AS n_alerts, COALESCE(s.alert_rate, 0.0) AS alert_rate,
              COALESCE(s.alert_rate, 0.0) >= 0.7 AS drift_detected,
              d.decay_checked, d.reference_auc, d.analysis_auc, d.auc_drop, d.decay_detected,
              n.negado_count, n.negado_denominator, n.negado_fraction, n.negado_below_threshold_retrain,
              m.probability_avg, m.probability_above_threshold_retrain
       FROM drift_sum s, decay d, denied n, mscore m""",
)

ORACLE["retrain_decision"] = with_views(
    """SELECT should_retrain, n_alerts, ROUND(alert_rate, 10) AS alert_rate, drift_detected, decay_checked,
              ROUND(reference_auc, 10) AS reference_auc, ROUND(analysis_auc, 10) AS analysis_auc,
              ROUND(auc_drop, 10) AS auc_drop, decay_detected, negado_count, negado_denominator,
              ROUND(negado_fraction, 10) AS negado_fraction, negado_below_threshold_retrain,
              ROUND(probability_avg, 10) AS probability_avg, probability_above_threshold_retrain FROM decision""",
    "monitoring", "predictions", ctes=DRIFT_CTES + DECAY_CTES + [DENIED_CTE, MEAN_CTE, DECISION_CTE],
)

ORACLE["decision_report_json"] = with_views(
    """SELECT CAST(to_json({'should_retrain': should_retrain, 'drift_detected': drift_detected,
                            'decay_detected': decay_detected, 'n_alerts': n_alerts,
                            'negado_count': negado_count, 'negado_denominator': negado_denominator}) AS VARCHAR) AS report
       FROM decision""",
    "monitoring", "predictions", ctes=DRIFT_CTES + DECAY_CTES + [DENIED_CTE, MEAN_CTE, DECISION_CTE],
)


# --- requests and the prediction log --------------------------------------------------------



def _lit(v) -> str:
    t = default_text(v)
    return "NULL::VARCHAR" if t is None else "'" + t.replace("'", "''") + "'"


DECODED_CTE = (
    "decoded",
    """
    SELECT *,
      CASE WHEN value IS NULL THEN 'empty value'
           WHEN NOT json_valid(value) THEN 'invalid JSON'
           WHEN json_type(value::JSON) <> 'OBJECT' THEN 'value must be a JSON object' END AS decode_error,
      CASE WHEN value IS NULL OR NOT json_valid(value) OR json_type(value::JSON) <> 'OBJECT' THEN NULL
           WHEN json_type(value::JSON, '$.payload') = 'OBJECT' THEN 'payload'
           WHEN json_type(value::JSON, '$.application') = 'OBJECT' THEN 'application'
           WHEN json_type(value::JSON, '$.data') = 'OBJECT' THEN 'data'
           WHEN json_type(value::JSON, '$.body') = 'OBJECT' THEN 'body'
           ELSE 'bare' END AS envelope
    FROM request_messages""",
)

PAYLOAD_CTE = (
    "pl",
    """
    SELECT *, CASE envelope WHEN 'bare' THEN value::JSON
                            WHEN 'payload' THEN json_extract(value, '$.payload')
                            WHEN 'application' THEN json_extract(value, '$.application')
                            WHEN 'data' THEN json_extract(value, '$.data')
                            WHEN 'body' THEN json_extract(value, '$.body') END AS payload
    FROM decoded""",
)


def _text(name: str, default) -> str:
    present = f"json_exists(payload, '$.{name}')"
    return f"(CASE WHEN {present} THEN json_extract_string(payload, '$.{name}') ELSE {_lit(default)} END)"


def _norm_select(processing_date: str) -> tuple[str, str]:
    cols, reasons, wrong = [], [], []
    for f in REQUEST_FIELDS:
        t = _text(f.name, f.default)
        if f.name == "id_cliente":
            t = f"COALESCE({t}, '0')"
        if f.name == "data_decisao":
            t = f"(CASE WHEN {t} IS NULL OR {t} = '' THEN '{processing_date}' ELSE {t} END)"
        if f.kind == "id":
            tt = f"trim({t})"
            dflt = "NULL::BIGINT" if f.default is None else f"CAST({f.default} AS BIGINT)"
            cols.append(f"CASE WHEN {tt} IS NULL OR {tt} = '' THEN {dflt} "
                        f"WHEN regexp_full_match({tt}, '[+-]?[0-9]+') THEN TRY_CAST({tt} AS BIGINT) END AS {f.name}")
            reasons.append(f"CASE WHEN NOT ({tt} IS NULL OR {tt} = '') AND NOT (regexp_full_match({tt}, '[+-]?[0-9]+') "
                           f"AND TRY_CAST({tt} AS BIGINT) IS NOT NULL) THEN '{f.name}: numeric id expected' END")
        elif f.kind == "str":
            other = f"COALESCE(json_type(payload, '$.{f.name}') NOT IN ('VARCHAR', 'NULL'), false)"
            held = f"(CASE WHEN {other} THEN NULL ELSE {t} END)"
            if f.name == "data_decisao":
                held = t
            cols.append(f"{held} AS {f.name}")
            if f.required:
                reasons.append(f"CASE WHEN {t} IS NULL AND NOT {other} THEN '{f.name}: required' END")
            wrong.append(f"CASE WHEN {other} THEN '{f.name}: text expected' END")
        elif f.kind == "float":
            d = f"TRY_CAST({t} AS DOUBLE)"
            cols.append(f"{d} AS {f.name}")
            req = "true" if f.required else "false"
            reasons.append(f"CASE WHEN ({t} IS NULL AND {req}) OR ({t} IS NOT NULL AND {d} IS NULL) "
                           f"THEN '{f.name}: number expected' END")
        else:
            d = f"TRY_CAST({t} AS DOUBLE)"
            whole = (f"({d} IS NOT NULL AND {d} = floor({d}) AND "
                     f"regexp_full_match(trim({t}), '[+-]?[0-9]+(\\.[0-9]*)?([eE][+-]?[0-9]+)?'))")
            cols.append(f"CASE WHEN {whole} THEN TRY_CAST({d} AS INTEGER) END AS {f.name}")
            req = "true" if f.required else "false"
            reasons.append(f"CASE WHEN ({t} IS NULL AND {req}) OR ({t} IS NOT NULL AND NOT COALESCE({whole} AND TRY_CAST({d} AS INTEGER) IS NOT NULL, false)) "
                           f"THEN '{f.name}: integer expected' END")
    rs = ("CASE WHEN decode_error IS NOT NULL THEN [decode_error] ELSE "
          "list_filter([" + ", ".join(reasons + wrong) + "], lambda x: x IS NOT NULL) END AS reasons")
    return ",\n".join(cols), rs


_NCOLS, _NREASONS = _norm_select("2024-02-01")
NORM_CTE = ("norm", f"SELECT key, value, topic, \"partition\", \"offset\", \"timestamp\", envelope, decode_error,\n{_NCOLS},\n{_NREASONS}\nFROM pl")

SCORED_CTE = (
    "scored",
    """
    SELECT *, CASE WHEN key IS NULL OR key = '' THEN sha256(concat_ws('|', topic, CAST("partition" AS VARCHAR),
                                                                        CAST("offset" AS VARCHAR))) ELSE key END AS event_id,
              "timestamp" AS event_ts, 'credit_default' AS model_name, 'Production' AS model_stage,
              CASE WHEN len(reasons) = 0 THEN least(valor_credito / 500.0, 1.0) END AS p_raw
    FROM norm""",
)

REQ_VIEWS = ("request_messages",)
REQ_CTES = [DECODED_CTE, PAYLOAD_CTE, NORM_CTE, SCORED_CTE]
FIELD_LIST = ", ".join(f.name for f in REQUEST_FIELDS)

ORACLE["decision_bands"] = with_views(
    """SELECT event_id, ROUND(probability, 4) AS probability_4,
              CASE WHEN probability IS NULL THEN NULL WHEN probability > 0.5 THEN 'Negado'
                   WHEN probability > 0.3 THEN 'Revisão Manual' ELSE 'Aprovado' END AS threshold_decision
       FROM predictions""",
    "predictions",
)

ORACLE["request_envelopes"] = with_views(
    "SELECT key, envelope, decode_error, json_extract_string(payload, '$.tipo_contrato') AS tipo_contrato FROM pl",
    *REQ_VIEWS, ctes=[DECODED_CTE, PAYLOAD_CTE],
)

ORACLE["request_ids"] = with_views(
    """SELECT key,
              CASE WHEN trim(t) IS NULL OR trim(t) = '' THEN 0::BIGINT
                   WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') THEN TRY_CAST(trim(t) AS BIGINT) END AS id_cliente,
              CASE WHEN trim(t) IS NULL OR trim(t) = '' THEN NULL
                   WHEN regexp_full_match(trim(t), '[+-]?[0-9]+') AND TRY_CAST(trim(t) AS BIGINT) IS NOT NULL THEN NULL
                   ELSE 'non-numeric id' END AS id_error
       FROM (SELECT key, json_extract_string(payload, '$.id_cliente') AS t FROM pl)""",
    *REQ_VIEWS, ctes=[DECODED_CTE, PAYLOAD_CTE],
)

ORACLE["request_normalized"] = with_views(f"SELECT key, {FIELD_LIST}, reasons FROM norm", *REQ_VIEWS, ctes=REQ_CTES[:3])

ORACLE["prediction_events_log"] = with_views(
    f"""SELECT event_id, event_ts, model_name, model_stage, event_id AS request_id, ROUND(p_raw, 4) AS probability,
               CASE WHEN p_raw IS NULL THEN NULL WHEN p_raw > 0.5 THEN 'Negado' WHEN p_raw > 0.3 THEN 'Revisão Manual'
                    ELSE 'Aprovado' END AS threshold_decision,
               'success' AS status, {FIELD_LIST}
        FROM scored WHERE len(reasons) = 0""",
    *REQ_VIEWS, ctes=REQ_CTES,
)

ORACLE["prediction_requests_log"] = with_views(
    f"SELECT event_id, event_ts, model_name, model_stage, {FIELD_LIST} FROM scored WHERE len(reasons) = 0",
    *REQ_VIEWS, ctes=REQ_CTES,
)

ORACLE["rejected_requests"] = with_views(
    'SELECT event_id, key, "offset", reasons FROM scored WHERE len(reasons) > 0', *REQ_VIEWS, ctes=REQ_CTES,
)

ORACLE["events_join_requests"] = with_views(
    """SELECT CASE WHEN p_raw > 0.5 THEN 'Negado' WHEN p_raw > 0.3 THEN 'Revisão Manual' ELSE 'Aprovado' END
                AS threshold_decision, tipo_contrato, CAST(COUNT(*) AS BIGINT) AS n,
              ROUND(AVG(ROUND(p_raw, 4)), 8) AS avg_probability
       FROM scored WHERE len(reasons) = 0 GROUP BY 1, 2""",
    *REQ_VIEWS, ctes=REQ_CTES,
)

_ALLOWED = list(API_REQUIRED_FIELDS) + list(API_OPTIONAL_FIELDS)


def _evaluator_sql() -> str:
    bad = []
    for n in _ALLOWED:
        v = f"json_extract_string(payload, '$.{n}')"
        if n in REQUIRED_FALLBACKS:
            v = f"(CASE WHEN {v} IS NULL OR {v} = '' THEN {_lit(REQUIRED_FALLBACKS[n])} ELSE {v} END)"
        if n in API_INT_FIELDS:
            bad.append(f"NOT ({v} IS NULL OR (TRY_CAST({v} AS DOUBLE) IS NOT NULL AND regexp_full_match(trim({v}), '[+-]?[0-9]+') "
                       f"AND TRY_CAST(TRY_CAST({v} AS DOUBLE) AS INTEGER) IS NOT NULL))")
        elif n in API_FLOAT_FIELDS:
            bad.append(f"NOT ({v} IS NULL OR TRY_CAST({v} AS DOUBLE) IS NOT NULL)")
    valid = "NOT (" + " OR ".join(bad) + ")"
    missing = ("list_filter([" + ", ".join(
        f"CASE WHEN json_extract_string(payload, '$.{n}') IS NULL OR json_extract_string(payload, '$.{n}') = '' "
        f"THEN '{n}' END" for n in API_REQUIRED_FIELDS) + "], lambda x: x IS NOT NULL)")
    client = "trim(COALESCE(NULLIF(json_extract_string(payload, '$.id_cliente'), ''), 'unknown'))"
    contract = "trim(COALESCE(json_extract_string(payload, '$.id_contrato'), ''))"
    fits = " AND ".join(f"({c} = '' OR (regexp_full_match({c}, '[+-]?[0-9]+') AND TRY_CAST({c} AS BIGINT) IS NOT NULL))"
                        for c in (client, contract))
    return f"SELECT key, COALESCE({valid}, false) AS payload_valid, {fits} AS api_accepts, {missing} AS missing_fields FROM pl"


EVAL_CTE = ("evaluator", _evaluator_sql())

ORACLE["evaluator_accounting"] = with_views(
    """SELECT CAST(COUNT(CASE WHEN payload_valid AND api_accepts THEN 1 END) AS BIGINT) AS scored,
              CAST(COUNT(CASE WHEN NOT (payload_valid AND api_accepts) THEN 1 END) AS BIGINT) AS dropped,
              CAST(COUNT(CASE WHEN payload_valid AND NOT api_accepts THEN 1 END) AS BIGINT) AS api_rejected FROM evaluator""",
    *REQ_VIEWS, ctes=[DECODED_CTE, PAYLOAD_CTE, EVAL_CTE],
)

ORACLE["evaluator_top_missing"] = with_views(
    """SELECT field, CAST(COUNT(*) AS BIGINT) AS count
       FROM (SELECT unnest(missing_fields) AS field FROM evaluator WHERE NOT payload_valid)
       GROUP BY field ORDER BY count DESC, field ASC LIMIT 8""",
    *REQ_VIEWS, ctes=[DECODED_CTE, PAYLOAD_CTE, EVAL_CTE],
)


# --- sources, sinks and streaming --------------------------------------------------------------

ORACLE["csv_report_roundtrip"] = ORACLE["bad_rate_by_contract_type"]
ORACLE["prefix_merged"] = ORACLE["applications_merged"]
ORACLE["stream_prediction_events"] = ORACLE["prediction_events_log"]


# --- model preparation -------------------------------------------------------------------------

# M8: md5(id ':' seed) first 8 hex digits < 0.8 · 2^32 (= 0xcccccccc) ⟺ the hex text sorts below 'cccccccc'.
ORACLE["train_split"] = with_views(
    """SELECT substr(md5(CAST(c.id_contrato AS VARCHAR) || ':42'), 1, 8) < 'cccccccc' AS is_train,
              l.target_over60mob06, CAST(COUNT(*) AS BIGINT) AS n
       FROM contracts c JOIN contract_flags l ON c.id_contrato = l.id_contrato GROUP BY 1, 2""",
    "instalments", "contracts", ctes=[LABELS_CTE],
)

ORACLE["monitoring_job"] = with_views(
    """SELECT (COALESCE(s.drift_detected, false) OR COALESCE(d.decay_detected, false)
               OR COALESCE(n.negado_below_threshold_retrain, false)) AS should_retrain,
              COALESCE(s.n_alerts, 0) AS n_alerts, ROUND(COALESCE(s.alert_rate, 0.0), 10) AS alert_rate,
              COALESCE(s.alert_rate, 0.0) >= 0.7 AS drift_detected,
              d.decay_checked, ROUND(d.reference_auc, 10) AS reference_auc, ROUND(d.analysis_auc, 10) AS analysis_auc,
              ROUND(d.auc_drop, 10) AS auc_drop, d.decay_detected,
              n.negado_count, n.negado_denominator, ROUND(n.negado_fraction, 10) AS negado_fraction,
              n.negado_below_threshold_retrain
       FROM drift_sum s, decay d, denied n""",
    "monitoring", "predictions", ctes=DRIFT_CTES + DECAY_CTES + [DENIED_CTE],
)

ORACLE["mode_fill"] = with_views(
    """SELECT id_cliente, COALESCE(possui_carro, (
              SELECT possui_carro FROM profile WHERE possui_carro IS NOT NULL
              GROUP BY possui_carro ORDER BY COUNT(*) DESC, possui_carro ASC LIMIT 1)) AS possui_carro
       FROM profile""",
    "profile",
)

ORACLE["train_split_stratified"] = with_views(
    """SELECT is_train, target_over60mob06, CAST(COUNT(*) AS BIGINT) AS n FROM (
         SELECT l.target_over60mob06,
                row_number() OVER (PARTITION BY l.target_over60mob06
                                   ORDER BY md5(CAST(c.id_contrato AS VARCHAR) || ':42'), c.id_contrato)
                  <= round(COUNT(*) OVER (PARTITION BY l.target_over60mob06) * 0.8) AS is_train
         FROM contracts c JOIN contract_flags l ON c.id_contrato = l.id_contrato)
       GROUP BY 1, 2""",
    "instalments", "contracts", ctes=[LABELS_CTE],
)

_IN_TRAIN = "substr(md5(CAST({} AS VARCHAR) || ':42'), 1, 8) < 'cccccccc'"

ORACLE["local_model_scores"] = with_views(
    f"""SELECT id_contrato, target_over60mob06,
               ROUND(1.0 / (1.0 + exp(-(2e-06 * COALESCE(valor_credito, 0) - 1e-05 * COALESCE(valor_parcela, 0)
                     + 0.03 * COALESCE(hora_solicitacao, 0) - 0.4 * COALESCE(ltv, 0) - 0.25))), 9) AS prediction_proba
        FROM (SELECT c.*, l.target_over60mob06,
                     c.valor_credito / CASE WHEN COALESCE(CASE WHEN c.valor_bem <> 0 THEN c.valor_bem END, c.valor_credito) <> 0
                       THEN COALESCE(CASE WHEN c.valor_bem <> 0 THEN c.valor_bem END, c.valor_credito) END AS ltv
              FROM contracts c JOIN contract_flags l ON c.id_contrato = l.id_contrato)
        WHERE NOT ({_IN_TRAIN.format('id_contrato')})""",
    "instalments", "contracts", ctes=[LABELS_CTE],
)

ORACLE["prepared_slots"] = with_views(
    """SELECT id_contrato, slot, ROUND(value, 6) AS value FROM (
         SELECT h.id_contrato, 'valor_bem' AS slot, COALESCE(h.valor_bem, m.valor_bem) AS value FROM held h, medians m
         UNION ALL SELECT h.id_contrato, 'renda_anual', COALESCE(h.renda_anual, m.renda_anual) FROM held h, medians m
         UNION ALL SELECT h.id_contrato, 'hora_solicitacao', COALESCE(h.hora_solicitacao, m.hora_solicitacao) FROM held h, medians m
         UNION ALL SELECT f.id_contrato, f.name || '=' || f.category, 1.0 FROM filled f
           WHERE EXISTS (SELECT 1 FROM seen s WHERE s.name = f.name AND s.category = f.category))
       WHERE value <> 0""",
    "instalments", "contracts", "profile",
    ctes=[
        LABELS_CTE,
        ("frame", f"""SELECT c.id_contrato, c.valor_bem, CAST(c.hora_solicitacao AS DOUBLE) AS hora_solicitacao, p.renda_anual,
               p.possui_carro, CASE WHEN c.id_contrato % 11 <> 0 THEN c.tipo_contrato END AS tipo_contrato,
               CASE WHEN {_IN_TRAIN.format('c.id_contrato')} OR c.id_contrato % 7 <> 0 THEN p.tipo_renda ELSE 'never seen' END AS tipo_renda,
               {_IN_TRAIN.format('c.id_contrato')} AS is_train
             FROM contracts c JOIN contract_flags l ON c.id_contrato = l.id_contrato
             LEFT JOIN profile p ON c.id_cliente = p.id_cliente"""),
        ("held", "SELECT * FROM frame WHERE NOT is_train"),
        ("medians", """SELECT quantile_cont(valor_bem, 0.5) AS valor_bem, quantile_cont(renda_anual, 0.5) AS renda_anual,
             quantile_cont(hora_solicitacao, 0.5) AS hora_solicitacao FROM frame WHERE is_train"""),
        ("texts", """SELECT id_contrato, is_train, 'tipo_contrato' AS name, tipo_contrato AS category FROM frame
             UNION ALL SELECT id_contrato, is_train, 'possui_carro', possui_carro FROM frame
             UNION ALL SELECT id_contrato, is_train, 'tipo_renda', tipo_renda FROM frame"""),
        ("modes", """SELECT name, category FROM (
             SELECT name, category, row_number() OVER (PARTITION BY name ORDER BY COUNT(*) DESC, category) AS rn
             FROM texts WHERE is_train AND category IS NOT NULL GROUP BY 1, 2) WHERE rn = 1"""),
        ("seen", "SELECT DISTINCT name, category FROM texts WHERE is_train AND category IS NOT NULL"),
        ("filled", """SELECT t.id_contrato, t.name, COALESCE(t.category, m.category) AS category
             FROM texts t LEFT JOIN modes m ON t.name = m.name WHERE NOT t.is_train"""),
    ],
)

ORACLE["strict_decision_dates"] = with_views("SELECT id_contrato, data_decisao FROM contracts", "contracts")

ORACLE["aligned_features"] = with_views(
    """SELECT hora_solicitacao, 0 AS feat_unknown, ROUND(valor_credito, 10) AS valor_credito,
              'Country-wide' AS canal_venda, id_contrato FROM contracts""",
    "contracts",
)

ORACLE["dictionary_projection"] = with_views(
    "SELECT id_contrato, tipo_contrato, ROUND(valor_credito, 10) AS valor_credito FROM contracts", "contracts"
)

ORACLE["table_sink_lifecycle"] = with_views(
    """SELECT event_id, event_ts, ROUND(probability, 10) AS probability,
              CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM predictions""",
    "predictions",
)

ORACLE["instalments_merged"] = with_views(
    """
    SELECT b.id_contrato, b.id_cliente, ROUND(b.valor_pago, 6) AS valor_pago,
           p.tipo_renda, ROUND(p.renda_anual, 6) AS renda_anual, p.qtd_membros_familia, p.possui_carro, p.data_nascimento,
           c.data_decisao, c.tipo_contrato, c.status_contrato, ROUND(c.valor_credito, 6) AS valor_credito,
           ROUND(c.valor_solicitado, 6) AS valor_solicitado, ROUND(c.valor_bem, 6) AS valor_bem,
           ROUND(c.valor_parcela, 6) AS valor_parcela, c.hora_solicitacao,
           m.id_cliente_parcelas_mean, m.numero_parcela_parcelas_mean, m.valor_pago_parcelas_mean
    FROM instalments b LEFT JOIN profile p ON b.id_cliente = p.id_cliente
    LEFT JOIN contracts c ON b.id_contrato = c.id_contrato
    LEFT JOIN inst_means m ON b.id_contrato = m.id_contrato
    WHERE b.numero_parcela = 1""",
    "contracts", "profile", "instalments",
    ctes=[MEANS_CTE],
)

"""Schema-level column operations.

These act on schema metadata while the plan is built; they add no job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

# Columns named as post-approval leakage / sparse noise in the EDA.
LEAKAGE_COLUMNS = (
    "status_contrato",
    "motivo_recusa",
    "data_liberacao",
    "data_encerramento",
    "data_ultimo_vencimento",
    "taxa_juros_padrao",
    "taxa_juros_promocional",
    "flag_ultima_solicitacao_contrato",
    "flag_ultima_solicitacao_dia",
)

# The feature transformer's final cleaning list.
CLEANING_COLUMNS = (
    "id_cliente",
    "id_contrato",
    "data_decisao",
    "data_liberacao",
    "data_primeiro_vencimento",
    "data_ultimo_vencimento",
    "data_ultimo_vencimento_original",
    "data_encerramento",
    "data_nascimento",
    "renda_anual",
    "qtd_membros_familia",
    "possui_carro",
    "possui_imovel",
    "feat_comprometimento_renda",
    "feat_renda_per_capita",
    "feat_possui_carro",
    "feat_possui_imovel",
)


def align_columns(df: DataFrame, columns: Iterable[str], defaults: Mapping[str, object] | None = None,
                  fill=None) -> DataFrame:
    """Select ``columns`` in order; absent ones are added as ``defaults[c]`` (else ``fill``)."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.select([F.col(c) if c in have else F.lit(defaults.get(c, fill)).alias(c) for c in columns])


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the listed columns, ignoring absent ones."""
    return df.drop(*[c for c in columns if c in df.columns])


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """P28 helper: names of numeric (optionally also boolean) columns."""
    kinds = (NumericType, BooleanType) if include_bool else (NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def categorical_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """P28 helper: the complement of :func:`numeric_columns`."""
    num = set(numeric_columns(df, include_bool))
    return [c for c in df.columns if c not in num]


def select_numeric(df: DataFrame, include_bool: bool = False) -> DataFrame:
    """Keep numeric columns only."""
    return df.select(numeric_columns(df, include_bool))


def rename_collisions(right: DataFrame, left_columns: Iterable[str], key: str | Iterable[str],
                      suffix: str = "_submissao") -> DataFrame:
    """Right-side columns already present on the left get ``suffix`` (keys untouched)."""
    keys = {key} if isinstance(key, str) else set(key)
    left = set(left_columns)
    mapping = {c: f"{c}{suffix}" for c in right.columns if c in left and c not in keys}
    return right.withColumnsRenamed(mapping) if mapping else right


def common_feature_columns(reference: DataFrame, analysis: DataFrame,
                           exclude: Iterable[str] = ("timestamp", "target", "prediction")) -> list[str]:
    """Columns of ``analysis`` also in ``reference``, minus timestamp/target/prediction."""
    ex = {c for c in exclude if c}
    ref = set(reference.columns)
    return [c for c in analysis.columns if c not in ex and c in ref]

"""Training-set and monitoring-frame assembly.

Each builder is a function of DataFrames; joins are added only when their
key is on both sides. Aggregations happen before joins (labels per contract,
instalment means per contract) so no join fans out detail rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.functions import features as X
from lendwise.functions.columns import CLEANING_COLUMNS, align_columns, drop_columns, select_numeric
from lendwise.functions.dates import age_floor_days, date_of
from lendwise.operators import labels as L
from lendwise.operators.encoders import hash_split, ordinal_dictionary, ordinal_encode
from lendwise.operators.joins import left_join_if_keyed, left_join_latest, left_join_means, left_join_new_columns

# The categorical columns the feature transformer encodes.
ENCODED_CATEGORIES = (
    "tipo_contrato",
    "status_contrato",
    "tipo_pagamento",
    "finalidade_emprestimo",
    "tipo_cliente",
    "tipo_portfolio",
    "tipo_produto",
    "categoria_bem",
    "setor_vendedor",
    "canal_venda",
)


def training_set(
    contracts: DataFrame,
    instalments: DataFrame,
    profile: DataFrame | None = None,
    applications: DataFrame | None = None,
    contract_key: str = "id_contrato",
    client_key: str = "id_cliente",
    application_order: Sequence[str] = ("data_solicitacao",),
    fpd_days: int = L.FPD_DAYS,
    split_hot: bool = False,
) -> DataFrame:
    """M1: contracts ⋈ labels ⟕ profile ⟕ latest application per client (suffix ``_submissao``).

    ``application_order`` decides "latest"; end it with a unique tie-break.
    ``split_hot`` is for contracts of which a few clients hold much, such as
    the one that stands for every missing id.
    """
    lab = L.contract_labels(instalments, contract=contract_key, fpd_days=fpd_days)
    df = contracts.join(lab, contract_key, "inner")
    df = left_join_if_keyed(df, profile, client_key, split_hot=split_hot)
    return left_join_latest(df, applications, client_key, application_order, suffix="_submissao", split_hot=split_hot)


def notebook_training_set(contracts: DataFrame, instalments: DataFrame, profile: DataFrame,
                          contract_key: str = "id_contrato", client_key: str = "id_cliente") -> DataFrame:
    """M2: contracts ⟕ profile ⋈ OVER60MOB06 label only."""
    over60 = L.over60_labels(instalments, contract=contract_key)
    return left_join_if_keyed(contracts, profile, client_key).join(over60, contract_key, "inner")


def credit_features(
    df: DataFrame,
    dictionary: DataFrame | None = None,
    categories: Sequence[str] = ENCODED_CATEGORIES,
    keep_profile_features: bool = False,
    feature_names: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """M3: the feature block (P9–P13, P16, P17, M7), then the drop list and numeric-only.

    Every derived column is guarded by the presence of its inputs. With
    ``keep_profile_features`` the four profile features survive the final
    cleaning (the transformer drops them again by default). ``dictionary``
    is a fitted :func:`ordinal_dictionary`; without one the encoder is fit
    on ``df`` itself.
    """
    cols = set(df.columns)
    new = {}
    if "renda_anual" in cols:
        if "valor_parcela" in cols:
            new["feat_comprometimento_renda"] = X.instalment_to_income("valor_parcela", "renda_anual")
        if "qtd_membros_familia" in cols:
            new["feat_renda_per_capita"] = X.income_per_member("renda_anual", "qtd_membros_familia")
    if "possui_carro" in cols:
        new["feat_possui_carro"] = X.yes_no_flag("possui_carro", other=0)
    if "possui_imovel" in cols:
        new["feat_possui_imovel"] = X.yes_no_flag("possui_imovel", other=0)
    if "data_nascimento" in cols and "data_decisao" in cols:
        new["feat_idade"] = age_floor_days(date_of(df, "data_decisao"), date_of(df, "data_nascimento"))
    if "valor_credito" in cols and "valor_bem" in cols:
        new["feat_ltv"] = X.loan_to_value("valor_credito", "valor_bem")
    if "hora_solicitacao" in cols:
        new["feat_hora_pico_fraude"] = X.risk_hour_flag("hora_solicitacao")
    out = df.withColumns(new) if new else df
    present = [c for c in categories if c in cols]
    if present:
        d = dictionary if dictionary is not None else ordinal_dictionary(df, present)
        out = ordinal_encode(out, present, d)
    drop = [c for c in CLEANING_COLUMNS
             if c not in keep and not (keep_profile_features and c.startswith("feat_"))]
    out = select_numeric(drop_columns(out, drop))
    if feature_names is not None:
        out = align_columns(out, list(keep) + list(feature_names), fill=0)
    return out


def split_credit_features(df: DataFrame, key: str = "id_contrato", fraction: float = 0.8, seed: int = 42,
                          categories: Sequence[str] = ENCODED_CATEGORIES) -> DataFrame:
    """M8 + M3: split by ``key``, category codes learned from the training side alone, then the feature block of all rows.

    A category that only validation rows hold gets the code of unseen ones.
    Learning the codes reads the rows several times, so where there are any
    the split rows are checkpointed first: the joins below run once.
    """
    from lendwise.plans.train import training_frame

    split = hash_split(df, key, fraction, seed)
    present = [c for c in categories if c in df.columns]
    split = training_frame(split) if present else split
    dictionary = ordinal_dictionary(split.where("is_train"), present) if present else None
    # the flag is no number, and the feature block keeps numbers only
    feats = credit_features(split.withColumn("__train", F.col("is_train").cast("int")), dictionary, categories, keep=[key])
    return feats.withColumn("is_train", F.col("__train") == 1).drop("__train")


def merge_lending_tables(
    base: DataFrame,
    profile: DataFrame | None = None,
    contracts: DataFrame | None = None,
    instalments: DataFrame | None = None,
    client_key: str = "id_cliente",
    contract_key: str = "id_contrato",
) -> DataFrame:
    """Base ⟕ profile (new columns) ⟕ contracts (new columns) ⟕ instalment means."""
    df = left_join_new_columns(base, profile, client_key)
    df = left_join_new_columns(df, contracts, contract_key)
    return left_join_means(df, instalments, contract_key)

"""Request payload specification: fields, types, defaults and fallbacks.

The request schema is data (a list of field specs) so that the Spark
expressions and the log-table schemas are generated from one place.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # "id", "str", "float", "int"
    required: bool
    default: object


# The scoring request schema in declaration order, with the
# service's default payload (``None`` = no default). kind "id" = numeric id.
REQUEST_FIELDS: tuple[Field, ...] = (
    Field("id_cliente", "id", False, 0),
    Field("id_contrato", "id", False, None),
    Field("tipo_contrato", "str", True, "Cash loans"),
    Field("status_contrato", "str", True, "Approved"),
    Field("tipo_pagamento", "str", True, "Cash through a bank"),
    Field("finalidade_emprestimo", "str", True, "XAP"),
    Field("tipo_cliente", "str", True, "Repeater"),
    Field("tipo_portfolio", "str", True, "POS"),
    Field("tipo_produto", "str", True, "XNA"),
    Field("categoria_bem", "str", True, "Mobile"),
    Field("setor_vendedor", "str", True, "Connectivity"),
    Field("canal_venda", "str", True, "Country-wide"),
    Field("faixa_rendimento", "str", False, None),
    Field("combinacao_produto", "str", False, None),
    Field("area_venda", "str", False, None),
    Field("dia_semana_solicitacao", "str", False, "Monday"),
    Field("data_nascimento", "str", True, "1990-01-01"),
    Field("data_decisao", "str", True, "2024-01-01"),
    Field("data_liberacao", "str", False, None),
    Field("data_primeiro_vencimento", "str", False, None),
    Field("data_ultimo_vencimento_original", "str", False, None),
    Field("data_ultimo_vencimento", "str", False, None),
    Field("data_encerramento", "str", False, None),
    Field("valor_solicitado", "float", True, 0.0),
    Field("valor_credito", "float", True, 0.0),
    Field("valor_bem", "float", True, 0.0),
    Field("valor_parcela", "float", True, 0.0),
    Field("valor_entrada", "float", True, 0.0),
    Field("percentual_entrada", "float", True, 0.0),
    Field("qtd_parcelas_planejadas", "int", True, 12),
    Field("taxa_juros_padrao", "float", True, 0.03),
    Field("taxa_juros_promocional", "float", True, 0.03),
    Field("hora_solicitacao", "int", True, 12),
    Field("flag_ultima_solicitacao_contrato", "int", True, 0),
    Field("flag_ultima_solicitacao_dia", "int", True, 0),
    Field("acompanhantes_cliente", "int", True, 0),
    Field("flag_seguro_contratado", "int", True, 0),
    Field("motivo_recusa", "str", False, None),
    Field("renda_anual", "float", False, None),
    Field("qtd_membros_familia", "int", False, None),
    Field("possui_carro", "str", False, None),
    Field("possui_imovel", "str", False, None),
    Field("sexo", "str", False, None),
    Field("qtd_filhos", "int", False, 0),
    Field("estado_civil", "str", False, None),
    Field("nivel_educacao", "str", False, None),
    Field("ocupacao", "str", False, None),
    Field("tipo_renda", "str", False, None),
    Field("tipo_moradia", "str", False, None),
    Field("tipo_organizacao", "str", False, None),
    Field("nota_regiao_cliente", "float", False, None),
    Field("nota_regiao_cliente_cidade", "float", False, None),
    Field("data_solicitacao", "str", False, None),
    Field("hora_solicitacao_submissao", "int", False, None),
    Field("dia_semana_solicitacao_submissao", "str", False, None),
    Field("tipo_contrato_submissao", "str", False, None),
    Field("valor_bem_submissao", "float", False, None),
    Field("valor_credito_submissao", "float", False, None),
    Field("valor_parcela_submissao", "float", False, None),
    Field("target_fpd", "int", False, 0),
    Field("target_ever30mob03", "int", False, 0),
)

# Envelope keys tried in order when unwrapping a message.
ENVELOPE_KEYS = ("payload", "application", "data", "body")

# Log-table types: float → DOUBLE, int → INT, ids → BIGINT, else STRING.
LOG_TYPES = {"id": "bigint", "str": "string", "float": "double", "int": "int"}

# Prediction-log metadata and response columns.
METADATA_COLUMNS = (("event_id", "string"), ("event_ts", "timestamp"), ("model_name", "string"), ("model_stage", "string"))
RESPONSE_COLUMNS = (("request_id", "string"), ("probability", "double"), ("threshold_decision", "string"),
                    ("status", "string"))

# Monitoring-side required fields (evaluator API contract).
API_REQUIRED_FIELDS = (
    "id_cliente",
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
    "data_nascimento",
    "data_decisao",
    "valor_solicitado",
    "valor_credito",
    "valor_bem",
    "valor_parcela",
    "valor_entrada",
    "percentual_entrada",
    "qtd_parcelas_planejadas",
    "taxa_juros_padrao",
    "taxa_juros_promocional",
    "hora_solicitacao",
    "flag_ultima_solicitacao_contrato",
    "flag_ultima_solicitacao_dia",
    "acompanhantes_cliente",
    "flag_seguro_contratado",
)

# Optional fields the evaluator also forwards.
API_OPTIONAL_FIELDS = (
    "id_contrato",
    "faixa_rendimento",
    "combinacao_produto",
    "area_venda",
    "dia_semana_solicitacao",
    "data_liberacao",
    "data_primeiro_vencimento",
    "data_ultimo_vencimento_original",
    "data_ultimo_vencimento",
    "data_encerramento",
    "motivo_recusa",
    "renda_anual",
    "qtd_membros_familia",
    "possui_carro",
    "possui_imovel",
)

# Evaluator casts (everything else is sent as is).
API_INT_FIELDS = (
    "qtd_parcelas_planejadas",
    "hora_solicitacao",
    "flag_ultima_solicitacao_contrato",
    "flag_ultima_solicitacao_dia",
    "acompanhantes_cliente",
    "flag_seguro_contratado",
    "qtd_membros_familia",
)
API_FLOAT_FIELDS = (
    "valor_solicitado",
    "valor_credito",
    "valor_bem",
    "valor_parcela",
    "valor_entrada",
    "percentual_entrada",
    "taxa_juros_padrao",
    "taxa_juros_promocional",
    "renda_anual",
)

# Evaluator fallbacks for required fields.
REQUIRED_FALLBACKS = {
    "id_cliente": "unknown",
    "tipo_contrato": "financiamento",
    "status_contrato": "ativo",
    "tipo_pagamento": "boleto",
    "finalidade_emprestimo": "compra_veiculo",
    "tipo_cliente": "pessoa_fisica",
    "tipo_portfolio": "varejo",
    "tipo_produto": "credito_pessoal",
    "categoria_bem": "automovel",
    "setor_vendedor": "digital",
    "canal_venda": "online",
    "data_nascimento": "1990-01-01",
    "data_decisao": "2024-01-01",
    "valor_solicitado": 0.0,
    "valor_credito": 0.0,
    "valor_bem": 0.0,
    "valor_parcela": 0.0,
    "valor_entrada": 0.0,
    "percentual_entrada": 0.0,
    "qtd_parcelas_planejadas": 12,
    "taxa_juros_padrao": 0.03,
    "taxa_juros_promocional": 0.03,
    "hora_solicitacao": 12,
    "flag_ultima_solicitacao_contrato": 0,
    "flag_ultima_solicitacao_dia": 0,
    "acompanhantes_cliente": 0,
    "flag_seguro_contratado": 0,
}


def default_text(value: object) -> str | None:
    """Text form of a default as it would appear in a JSON-decoded string map."""
    if value is None:
        return None
    if isinstance(value, float):
        return repr(value)
    return str(value)

"""Source-table registry (S2) and the domain's fixed values.

Every source extract is read as text by header name and then cast by name
with this registry, so column order in a file does not matter.  Columns not
listed under ``int``/``double`` are strings: identifiers such as ``007`` keep
their leading zeros.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the source system's extracts and the original
# analysis (table names, column names, status strings, bands, seeds).
# ---------------------------------------------------------------------------

TABLE_COLUMNS: dict[str, list[str]] = {
    "programa": [
        "ID_PROGRAMA", "COD_ORGAO_SUP_PROGRAMA", "DESC_ORGAO_SUP_PROGRAMA", "COD_PROGRAMA",
        "NOME_PROGRAMA", "SIT_PROGRAMA", "DATA_DISPONIBILIZACAO", "ANO_DISPONIBILIZACAO",
        "DT_PROG_INI_RECEB_PROP", "DT_PROG_FIM_RECEB_PROP", "DT_PROG_INI_EMENDA_PAR",
        "DT_PROG_FIM_EMENDA_PAR", "DT_PROG_INI_BENEF_ESP", "DT_PROG_FIM_BENEF_ESP",
        "MODALIDADE_PROGRAMA", "NATUREZA_JURIDICA_PROGRAMA", "UF_PROGRAMA", "ACAO_ORCAMENTARIA",
    ],
    "proponentes": [
        "IDENTIF_PROPONENTE", "NM_PROPONENTE", "MUNICIPIO_PROPONENTE", "UF_PROPONENTE",
        "ENDERECO_PROPONENTE", "BAIRRO_PROPONENTE", "CEP_PROPONENTE", "EMAIL_PROPONENTE",
        "TELEFONE_PROPONENTE", "FAX_PROPONENTE",
    ],
    "proposta": [
        "ID_PROPOSTA", "UF_PROPONENTE", "MUNIC_PROPONENTE", "COD_MUNIC_IBGE", "COD_ORGAO_SUP",
        "DESC_ORGAO_SUP", "NATUREZA_JURIDICA", "NR_PROPOSTA", "DIA_PROP", "MES_PROP", "ANO_PROP",
        "DIA_PROPOSTA", "COD_ORGAO", "DESC_ORGAO", "MODALIDADE", "IDENTIF_PROPONENTE",
        "NM_PROPONENTE", "CEP_PROPONENTE", "ENDERECO_PROPONENTE", "BAIRRO_PROPONENTE", "NM_BANCO",
        "SITUACAO_CONTA", "SITUACAO_PROJETO_BASICO", "SIT_PROPOSTA", "DIA_INIC_VIGENCIA_PROPOSTA",
        "DIA_FIM_VIGENCIA_PROPOSTA", "OBJETO_PROPOSTA", "ITEM_INVESTIMENTO", "ENVIADA_MANDATARIA",
        "VL_GLOBAL_PROP", "VL_REPASSE_PROP", "VL_CONTRAPARTIDA_PROP",
    ],
    "convenio": [
        "NR_CONVENIO", "ID_PROPOSTA", "DIA", "MES", "ANO", "DIA_ASSIN_CONV", "SIT_CONVENIO",
        "SUBSITUACAO_CONV", "SITUACAO_PUBLICACAO", "INSTRUMENTO_ATIVO", "IND_OPERA_OBTV",
        "NR_PROCESSO", "UG_EMITENTE", "DIA_PUBL_CONV", "DIA_INIC_VIGENC_CONV", "DIA_FIM_VIGENC_CONV",
        "DIA_FIM_VIGENC_ORIGINAL_CONV", "DIAS_PREST_CONTAS", "DIA_LIMITE_PREST_CONTAS",
        "DATA_SUSPENSIVA", "DATA_RETIRADA_SUSPENSIVA", "DIAS_CLAUSULA_SUSPENSIVA",
        "SITUACAO_CONTRATACAO", "IND_ASSINADO", "MOTIVO_SUSPENSAO", "IND_FOTO", "QTDE_CONVENIOS",
        "QTD_TA", "QTD_PRORROGA", "VL_GLOBAL_CONV", "VL_REPASSE_CONV", "VL_CONTRAPARTIDA_CONV",
        "VL_EMPENHADO_CONV", "VL_DESEMBOLSADO_CONV", "VL_SALDO_REMAN_TESOURO",
        "VL_SALDO_REMAN_CONVENENTE", "VL_RENDIMENTO_APLICACAO", "VL_INGRESSO_CONTRAPARTIDA",
        "VL_SALDO_CONTA", "VALOR_GLOBAL_ORIGINAL_CONV",
    ],
    "desembolso": [
        "ID_DESEMBOLSO", "NR_CONVENIO", "DT_ULT_DESEMBOLSO", "QTD_DIAS_SEM_DESEMBOLSO",
        "DATA_DESEMBOLSO", "ANO_DESEMBOLSO", "MES_DESEMBOLSO", "NR_SIAFI", "VL_DESEMBOLSADO",
    ],
    "empenho": [
        "ID_EMPENHO", "NR_CONVENIO", "NR_EMPENHO", "TIPO_NOTA", "DESC_TIPO_NOTA", "DATA_EMISSAO",
        "COD_SITUACAO_EMPENHO", "DESC_SITUACAO_EMPENHO", "VALOR_EMPENHO",
    ],
    "meta_crono_fisico": [
        "ID_META", "NR_CONVENIO", "COD_PROGRAMA", "NOME_PROGRAMA", "NR_META", "TIPO_META",
        "DESC_META", "DATA_INICIO_META", "DATA_FIM_META", "UF_META", "MUNICIPIO_META",
        "ENDERECO_META", "CEP_META", "QTD_META", "UND_FORNECIMENTO_META", "VL_META",
    ],
    "pagamento": [
        "NR_MOV_FIN", "NR_CONVENIO", "IDENTIF_FORNECEDOR", "NOME_FORNECEDOR", "TP_MOV_FINANCEIRA",
        "DATA_PAG", "NR_DL", "DESC_DL", "VL_PAGO",
    ],
    "consorcios": [
        "ID_PROPOSTA", "CNPJ_CONSORCIO", "NOME_CONSORCIO", "CODIGO_CNAE_PRIMARIO",
        "DESC_CNAE_PRIMARIO", "CODIGO_CNAE_SECUNDARIO", "DESC_CNAE_SECUNDARIO",
        "CNPJ_PARTICIPANTE", "NOME_PARTICIPANTE",
    ],
    "desbloqueio_cr": [
        "NR_CONVENIO", "NR_OB", "DATA_CADASTRO", "DATA_ENVIO", "TIPO_RECURSO_DESBLOQUEIO",
        "VL_TOTAL_DESBLOQUEIO", "VL_DESBLOQUEADO", "VL_BLOQUEADO",
    ],
    "emenda": [
        "ID_PROPOSTA", "QUALIF_PROPONENTE", "COD_PROGRAMA_EMENDA", "NR_EMENDA", "NOME_PARLAMENTAR",
        "BENEFICIARIO_EMENDA", "IND_IMPOSITIVO", "TIPO_PARLAMENTAR",
        "VALOR_REPASSE_PROPOSTA_EMENDA", "VALOR_REPASSE_EMENDA",
    ],
    "etapa_crono_fisico": [
        "ID_META", "ID_ETAPA", "NR_ETAPA", "DESC_ETAPA", "DATA_INICIO_ETAPA", "DATA_FIM_ETAPA",
        "UF_ETAPA", "MUNICIPIO_ETAPA", "ENDERECO_ETAPA", "CEP_ETAPA", "QTD_ETAPA",
        "UND_FORNECIMENTO_ETAPA", "VL_ETAPA",
    ],
    "ingresso_contrapartida": ["NR_CONVENIO", "DT_INGRESSO_CONTRAPARTIDA", "VL_INGRESSO_CONTRAPARTIDA"],
    "obtv_convenente": [
        "NR_MOV_FIN", "IDENTIF_FAVORECIDO_OBTV_CONV", "NM_FAVORECIDO_OBTV_CONV", "TP_AQUISICAO",
        "VL_PAGO_OBTV_CONV",
    ],
    "plano_aplicacao_detalhado": [
        "ID_PROPOSTA", "SIGLA", "MUNICIPIO", "NATUREZA_AQUISICAO", "DESCRICAO_ITEM", "CEP_ITEM",
        "ENDERECO_ITEM", "TIPO_DESPESA_ITEM", "NATUREZA_DESPESA", "SIT_ITEM",
        "COD_NATUREZA_DESPESA", "QTD_ITEM", "VALOR_UNITARIO_ITEM", "VALOR_TOTAL_ITEM",
    ],
    "prorroga_oficio": [
        "NR_CONVENIO", "NR_PRORROGA", "DT_INICIO_PRORROGA", "DT_FIM_PRORROGA", "DIAS_PRORROGA",
        "DT_ASSINATURA_PRORROGA", "SIT_PRORROGA",
    ],
    "termo_aditivo": [
        "NR_CONVENIO", "NUMERO_TA", "TIPO_TA", "VL_GLOBAL_TA", "VL_REPASSE_TA",
        "VL_CONTRAPARTIDA_TA", "DT_ASSINATURA_TA", "DT_INICIO_TA", "DT_FIM_TA", "JUSTIFICATIVA_TA",
    ],
    "empenho_desembolso": ["ID_DESEMBOLSO", "ID_EMPENHO", "VALOR_GRUPO"],
    "historico_situacao": [
        "ID_PROPOSTA", "NR_CONVENIO", "DIA_HISTORICO_SIT", "HISTORICO_SIT", "DIAS_HISTORICO_SIT",
        "COD_HISTORICO_SIT",
    ],
    "programa_proposta": ["ID_PROGRAMA", "ID_PROPOSTA"],
}

# Non-string columns per table (everything else is a string).
INT_COLUMNS: dict[str, list[str]] = {
    "convenio": ["MES", "QTDE_CONVENIOS", "QTD_TA", "QTD_PRORROGA"],
}
DOUBLE_COLUMNS: dict[str, list[str]] = {
    "proposta": ["VL_GLOBAL_PROP", "VL_REPASSE_PROP", "VL_CONTRAPARTIDA_PROP"],
    "convenio": [
        "DIAS_CLAUSULA_SUSPENSIVA", "VL_GLOBAL_CONV", "VL_REPASSE_CONV", "VL_CONTRAPARTIDA_CONV",
        "VL_EMPENHADO_CONV", "VL_DESEMBOLSADO_CONV", "VL_SALDO_REMAN_TESOURO",
        "VL_SALDO_REMAN_CONVENENTE", "VL_RENDIMENTO_APLICACAO", "VL_INGRESSO_CONTRAPARTIDA",
        "VL_SALDO_CONTA", "VALOR_GLOBAL_ORIGINAL_CONV",
    ],
    "desembolso": ["VL_DESEMBOLSADO"],
    "empenho": ["VALOR_EMPENHO"],
    "meta_crono_fisico": ["VL_META"],
    "pagamento": ["VL_PAGO"],
    "desbloqueio_cr": ["VL_TOTAL_DESBLOQUEIO", "VL_DESBLOQUEADO", "VL_BLOQUEADO"],
    "emenda": ["VALOR_REPASSE_PROPOSTA_EMENDA", "VALOR_REPASSE_EMENDA"],
    "etapa_crono_fisico": ["VL_ETAPA"],
    "ingresso_contrapartida": ["VL_INGRESSO_CONTRAPARTIDA"],
    "obtv_convenente": ["VL_PAGO_OBTV_CONV"],
    "plano_aplicacao_detalhado": ["VALOR_UNITARIO_ITEM", "VALOR_TOTAL_ITEM"],
    "termo_aditivo": ["VL_GLOBAL_TA", "VL_REPASSE_TA", "VL_CONTRAPARTIDA_TA"],
    "empenho_desembolso": ["VALOR_GRUPO"],
}

# Tables the pipeline loads, in load order; the others are schema-only.
LOADED_TABLES = ["convenio", "proposta", "consorcios", "emenda"]
# Full load order of the source system's extracts.
INSERTION_ORDER = [
    "programa", "proponentes", "proposta", "convenio", "desembolso", "empenho",
    "meta_crono_fisico", "pagamento", "consorcios", "desbloqueio_cr", "emenda",
    "etapa_crono_fisico", "ingresso_contrapartida", "obtv_convenente",
    "plano_aplicacao_detalhado", "prorroga_oficio", "termo_aditivo", "empenho_desembolso",
    "historico_situacao", "programa_proposta",
]
FILE_PREFIX = "siconv_"

# Agreement statuses: final outcomes kept at load time and their label.
STATUS_NEGATIVE = ["Prestação de Contas Aprovada", "Prestação de Contas Aprovada com Ressalvas"]
STATUS_POSITIVE = ["Inadimplente", "Prestação de Contas Rejeitada", "Convênio Rescindido"]
FINAL_STATUSES = STATUS_NEGATIVE + STATUS_POSITIVE

# Value bands (right-closed): (0,33000] (33000,330000] (330000,3300000] (3300000,inf).
VALUE_BAND_EDGES = [0.0, 33000.0, 330000.0, 3300000.0]
VALUE_BAND_LABELS = ["dispensa", "convite", "tomada", "concorrencia"]

DATE_FORMAT = "dd/MM/yyyy"
MISSING = "missing"
SEED = 6439
HOLDOUT_SHARE = 0.1
N_FOLDS = 10
DEFAULT_POS_WEIGHT = 20.0
RESAMPLE_RATIOS = [0.1, 0.2, 1.0]            # 10:1, 5:1, 1:1
SMOTE_NEARMISS_RATIOS = [0.1, 0.175, 0.5]
SMOTE_K = 5
NEARMISS_K = 3

# ---------------------------------------------------------------------------
# Column roles of the agreement / feature tables.
# ---------------------------------------------------------------------------

AGREEMENT_COLUMNS = [
    "NR_CONVENIO", "ID_PROPOSTA", "SIT_CONVENIO", "QTD_TA", "QTD_PRORROGA", "MES",
    "QTDE_CONVENIOS", "VL_GLOBAL_CONV", "VL_REPASSE_CONV", "VL_CONTRAPARTIDA_CONV",
    "VL_DESEMBOLSADO_CONV", "DIA_INIC_VIGENC_CONV", "DIA_FIM_VIGENC_CONV",
    "DIA_FIM_VIGENC_ORIGINAL_CONV",
]
PROPOSAL_COLUMNS = [
    "UF_PROPONENTE", "COD_MUNIC_IBGE", "COD_ORGAO_SUP", "COD_ORGAO", "MODALIDADE",
    "IDENTIF_PROPONENTE", "SITUACAO_CONTA", "SITUACAO_PROJETO_BASICO",
]
ZERO_FILL_COLUMNS = [
    "QTD_TA", "QTD_PRORROGA", "QTDE_CONVENIOS", "MES", "VL_GLOBAL_CONV", "VL_REPASSE_CONV",
    "VL_CONTRAPARTIDA_CONV", "VL_DESEMBOLSADO_CONV",
]
DATE_COLUMNS = ["DIA_INIC_VIGENC_CONV", "DIA_FIM_VIGENC_CONV", "DIA_FIM_VIGENC_ORIGINAL_CONV"]
# Columns removed before learning (ids, raw money, label, proponent id).
NON_FEATURE_COLUMNS = [
    "NR_CONVENIO", "ID_PROPOSTA", "SIT_CONVENIO", "VL_GLOBAL_CONV", "VL_REPASSE_CONV",
    "VL_CONTRAPARTIDA_CONV", "VL_DESEMBOLSADO_CONV", "TARGET", "IDENTIF_PROPONENTE",
]
CATEGORICAL_FEATURES = [
    "MES", "UF_PROPONENTE", "COD_MUNIC_IBGE", "COD_ORGAO_SUP", "COD_ORGAO", "MODALIDADE",
    "SITUACAO_CONTA", "SITUACAO_PROJETO_BASICO", "FAIXA_VALOR",
]
NUMERIC_FEATURES = [
    "QTD_TA", "QTD_PRORROGA", "QTDE_CONVENIOS", "EMENDAS", "CNPJS_CONSORCIOS",
    "PERC_REPASSE", "PERC_CONTRA", "PERC_DESEMBOLSADO", "DIF_ORIG", "DIF_PRORROG",
]
# Feature-set variants: all / without municipality / also without agencies.
VARIANT_DROPS = {
    "all": [],
    "sem_municipio": ["COD_MUNIC_IBGE"],
    "sem_municipio_orgao": ["COD_MUNIC_IBGE", "COD_ORGAO_SUP", "COD_ORGAO"],
}


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: list[str]
    ints: list[str] = field(default_factory=list)
    doubles: list[str] = field(default_factory=list)

    def type_of(self, col: str) -> T.DataType:
        if col in self.ints:
            return T.IntegerType()
        if col in self.doubles:
            return T.DoubleType()
        return T.StringType()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, self.type_of(c), True) for c in self.columns])

    def text_struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType(), True) for c in self.columns])


def spec(table: str) -> TableSpec:
    if table not in TABLE_COLUMNS:
        raise KeyError(f"unknown source table {table!r}")
    return TableSpec(table, TABLE_COLUMNS[table], INT_COLUMNS.get(table, []),
                     DOUBLE_COLUMNS.get(table, []))


def registry() -> dict[str, TableSpec]:
    return {t: spec(t) for t in TABLE_COLUMNS}

"""The columns of the two sides. Names are fixed values: they are those of the reports that come out.

Side A is the acquirer's settlement report, side L the ledger's receivables. Every row has `ord`, a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import functions as L
from ledgerloom.functions.codes import NOT_GIVEN
from ledgerloom.functions.money import MONEY

ACQUIRER, LEDGER = "rede", "shift"
MONEY_COLUMNS = ("valor_bruto_original", "valor_bruto_atualizado", "valor_mdr", "valor_liquido")
DATE_COLUMNS = ("data_recebimento", "data_venda", "data_vencimento", "data_cancelamento")
FOLDED_COLUMNS = ("taxa_mdr", "lote", "nome_estabelecimento", "estabelecimento", "numero_cartao", "banco", "agencia", "conta")
COMPARED = (
    "autorizacao", "nsu", "estabelecimento", "lote", "valor_bruto", "valor_liquido", "valor_mdr", "modalidade", "bandeira",
    "numero_parcelas", "parcela", "status", "data_venda", "data_recebimento", "data_vencimento",
)

#: Every column that a later step may read, and its type. Absent ones are added as nulls.
COMMON = {
    "ord": "bigint", "_source": "string", "_row": "bigint", "autorizacao": "string", "autorizacao_erro": "string", "nsu": "string",
    "valor_bruto": MONEY, "valor_liquido": MONEY, "valor_mdr": MONEY, "modalidade": "string", "bandeira": "string",
    "parcela": "int", "numero_parcelas": "int", "cancelamento": "string", "status": "string", "estabelecimento": "string",
    "nome_estabelecimento": "string", "lote": "string", "data_venda": "date", "data_recebimento": "date", "data_vencimento": "date",
}
RAW = tuple(f"raw_{c}" for c in COMPARED)
OF_ACQUIRER = {
    "rede_arquivo_origem": "string", "rede_origem_id": "string", "rede_aba_origem": "string", "rede_data_relatorio": "date",
    "rede_linha_original": "bigint", "rede_duplicado_entre_arquivos": "boolean", "rede_arquivos_duplicados": "string", "criterio_deduplicacao_rede": "string",
}
OF_LEDGER = {
    "_alertas_normalizacao": "array<string>", "_comparar_data_vencimento": "boolean", "valor_desconto": MONEY, "forma_pagamento": "string",
    "empresa": "string", "os_shift": "string", "codigo_conta": "string", "codigo_registro": "string", "descricao": "string",
    "descricao_credor_devedor": "string", "data_shift_usada_para_match": "date", "campo_data_shift_usado": "string",
}


def completed(df: DataFrame, *kinds: dict[str, str]) -> DataFrame:
    """df with all columns of those kinds, cast; other columns stay."""
    wanted = {name: kind for k in kinds for name, kind in k.items()}
    return df.withColumns({name: (F.col(name) if name in df.columns else F.lit(None)).cast(kind) for name, kind in wanted.items()})


def _with_raw(df: DataFrame) -> DataFrame:
    """A field without a raw_ column of its own is its own original."""
    return df.withColumns({raw: F.col(raw if raw in df.columns else raw.removeprefix("raw_")).cast("string") for raw in RAW})


def acquirer(df: DataFrame) -> DataFrame:
    return _with_raw(completed(df, COMMON, OF_ACQUIRER))


def ledger(df: DataFrame) -> DataFrame:
    own = _with_raw(completed(df, COMMON, OF_LEDGER))
    return own.withColumns({"_alertas_normalizacao": F.coalesce("_alertas_normalizacao", F.array().cast("array<string>")), "_comparar_data_vencimento": F.coalesce("_comparar_data_vencimento", F.lit(True))})


def _optional(df: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`").cast("string") if name is not None and name in df.columns else F.lit(None).cast("string")


def normalized(df: DataFrame, source: str, mapping: dict[str, str], fields: tuple[str, ...], carried: tuple[str, ...] = ()) -> DataFrame:
    """The canonical form of a mapped table: raw_ and normalised columns, ord and _row (line number as spreadsheets show it).

    mapping: canonical field to column. A missing column gives nulls, "" for status and cancelamento, and the not-given brand
    and modality; a missing cell does too. carried: columns that come along as they are.
    """
    if source not in (ACQUIRER, LEDGER):
        raise ValueError(f"source: {source!r} is neither {ACQUIRER!r} nor {LEDGER!r}")
    raw = {f: _optional(df, mapping.get(f)) for f in fields}
    wide = df.select("ord", *carried, (F.col("_line") + 2).alias("_row"), *(c.alias(f"raw_{f}") for f, c in raw.items()))
    given = {f for f in fields if mapping.get(f) in df.columns}
    rules = {f: (_rule(f), F.col(f"raw_{f}")) for f in fields if f in given} | {"_second": (L.installment_rule(1), F.col("raw_parcela"))}
    own = L.staged(wide, rules).withColumns({f: _absent(f) for f in fields if f not in given})
    fixed = {
        "_source": F.lit(source), "autorizacao": F.col("autorizacao.value"), "autorizacao_erro": F.col("autorizacao.error"), "numero_parcelas": F.coalesce("numero_parcelas", "_second"),
        "raw_valor_bruto": F.coalesce("raw_valor_bruto_atualizado", "raw_valor_bruto_original"), "valor_bruto": F.coalesce("valor_bruto_atualizado", "valor_bruto_original"),
    }
    return own.select(*(c for c in own.columns if c not in fixed and c != "_second"), *(c.alias(name) for name, c in fixed.items()))


def constants(source: str, fields: tuple[str, ...], given: set[str], columns: list[str]) -> dict[str, Column]:
    """Columns of a completed side that hold the same in all rows. given: the canonical fields that its table has; columns: those before completion."""
    none = {f"raw_{f}": F.lit(None).cast("string") for f in fields if f not in given}
    own = {f: _absent(f) for f in fields if f not in given and f not in ("numero_parcelas", "valor_bruto")}
    kinds = COMMON | (OF_ACQUIRER if source == ACQUIRER else OF_LEDGER)
    later = {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in columns}
    special = {"_alertas_normalizacao": F.array().cast(OF_LEDGER["_alertas_normalizacao"]), "_comparar_data_vencimento": F.lit(True)}
    return none | own | later | {c: v for c, v in special.items() if c in later} | {"_source": F.lit(source)}


def _absent(field: str) -> Column:
    """What the rules make of a missing column."""
    kind = "struct<value:string,error:string>" if field == "autorizacao" else MONEY if field in MONEY_COLUMNS else "date" if field in DATE_COLUMNS else "int" if field in ("parcela", "numero_parcelas") else "string"
    fixed = {"bandeira": NOT_GIVEN, "modalidade": NOT_GIVEN, "cancelamento": "", "status": ""}
    return F.lit(fixed.get(field)).cast(kind)


def _rule(field: str) -> L.Rule:
    if field in MONEY_COLUMNS:
        return L.AMOUNT
    if field in DATE_COLUMNS:
        return L.DATE
    own = {"autorizacao": L.authorization_rule(), "nsu": L.NSU, "bandeira": L.BRAND, "modalidade": L.MODALITY, "parcela": L.installment_rule(), "numero_parcelas": L.installment_rule(1), "cancelamento": L.FOLD, "status": L.FOLD}
    return own.get(field, L.FOLDED_TEXT)


#: Headers of the ledger's financial report.
REQUIRED_OF_REPORT = ("Valor bruto", "Nro autorização cartão")
ONE_OF_REPORT = ("Espécie", "Forma de pagamento/cobrança")
TEXTS_OF_REPORT = {
    "empresa": "Empresa", "descricao_credor_devedor": "Descrição Credor/Devedor", "codigo_conta": "Código da conta",
    "codigo_registro": "Código do registro", "codigo_classificacao": "Código Classificação", "descricao_classificacao": "Descriçao Classificação",
    "origem_conta": "Origem da conta", "lote_caixa": "Lote de caixa", "tipo_documento": "Tipo de documento", "tipo_conta": "Tipo da conta",
    "competencia": "Competência", "cnpj_credor_devedor": "C.N.P.J Credor/Devedor", "documento_shift": "Número do documento",
}
DAYS_OF_REPORT = {"data_vencimento": "Vencimento", "data_emissao": "Data de emissão", "data_lancamento": "Data do lançamento", "data_previsao": "Data previsão"}
#: What a reader adds to the report's rows.
CARRIED_OF_REPORT = ("arquivo", "origem_id")


def check_report(columns: list[str]) -> None:
    for name in REQUIRED_OF_REPORT:
        if name not in columns:
            raise ValueError(f'O relatório do Shift não contém a coluna essencial "{name}".')
    if not any(name in columns for name in ONE_OF_REPORT):
        raise ValueError('Não foi possível identificar pagamentos de cartão porque o relatório não possui "Espécie" nem "Forma de pagamento/cobrança".')


def normalized_report(df: DataFrame) -> DataFrame:
    """The canonical form of the ledger's financial report, with the alerts that its rows raise."""
    check_report(df.columns)
    col = lambda name: _optional(df, name)
    line = F.col("_source_line") if "_source_line" in df.columns else F.col("_line") + 2
    raw = {
        "raw_autorizacao": "Nro autorização cartão", "raw_valor_bruto": "Valor bruto", "raw_valor_liquido": "Valor líquido", "raw_valor_desconto": "Desconto", "raw_forma_pagamento": "Forma de pagamento/cobrança",
        "raw_especie": "Espécie", "raw_parcela": "Número da parcela", "raw_numero_parcelas": "Quantidade de parcelas", "raw_descricao": "Descrição",
    }
    wide = df.select("ord", *(c for c in CARRIED_OF_REPORT if c in df.columns), line.alias("_row"), *(col(header).alias(name) for name, header in raw.items()), *(col(header).alias(f"_raw_{k}") for k, header in enumerate(DAYS_OF_REPORT.values())), *(col(header).alias(f"_text_{name}") for name, header in TEXTS_OF_REPORT.items()))
    given = lambda name: F.col(f"raw_{name}")
    rules = {
        "_auth": (L.authorization_rule(keep_alphanumeric=True), given("autorizacao")), "valor_bruto": (L.AMOUNT, given("valor_bruto")), "valor_liquido": (L.AMOUNT, given("valor_liquido")), "valor_desconto": (L.AMOUNT, given("valor_desconto")),
        "_form": (L.payment_form_rule(), given("forma_pagamento")), "forma_pagamento": (L.FOLDED_TEXT, given("forma_pagamento")), "especie": (L.FOLDED_TEXT, given("especie")), "descricao": (L.TEXT, given("descricao")),
        "_current": (L.installment_rule(), given("parcela")), "_total": (L.installment_rule(), given("numero_parcelas")),
        **{name: (L.DATE, F.col(f"_raw_{k}")) for k, name in enumerate(DAYS_OF_REPORT)}, **{name: (L.TEXT, F.col(f"_text_{name}")) for name in TEXTS_OF_REPORT},
    }
    own = L.staged(wide, rules)
    current, total, inferred = F.col("_current"), F.col("_total"), F.col("_form.installments")
    neither = current.isNull() & total.isNull()
    alert = lambda when, code: F.when(when, F.lit(code))
    alerts = F.array_compact(
        F.array(
            alert(L.blank(given("autorizacao")), "AUTORIZACAO_VAZIA"),
            F.when(F.col("valor_bruto").isNull(), F.when(L.blank(given("valor_bruto")), F.lit("VALOR_VAZIO")).otherwise(F.lit("VALOR_BRUTO_INVALIDO"))),
            alert(F.lit("Forma de pagamento/cobrança" not in df.columns), "FORMA_PAGAMENTO_AUSENTE"),
            alert(neither & inferred.isNull(), "PARCELAMENTO_NAO_IDENTIFICADO"),
            alert(~neither & (total != inferred), "DIVERGENCIA_PARCELAMENTO_FORMA_PAGAMENTO"),
        )
    )
    issued, none = F.col("data_emissao"), F.lit(None)
    out = {
        "_source": F.lit(LEDGER), "origem": F.lit("SHIFT"), "_alertas_normalizacao": alerts, "autorizacao": F.col("_auth.value"), "autorizacao_erro": F.col("_auth.error"),
        "operadora": F.col("_form.operator"), "modalidade": F.col("_form.modality"), "bandeira": F.col("_form.brand"), "parcelas_inferidas_da_forma": inferred,
        "parcela": F.when(neither & inferred.isNotNull(), F.lit(1)).otherwise(current), "numero_parcelas": F.when(neither, inferred).otherwise(total),
        "os_shift": F.coalesce(L.service_order(F.col("raw_descricao")), L.service_order(F.col("_text_codigo_registro")), F.col("codigo_registro")),
        "possivel_nsu": F.col("documento_shift"), "_comparar_data_vencimento": F.lit(False),
        "data_venda": issued, "data_shift_usada_para_match": issued, "campo_data_shift_usado": F.lit("Data de emissão"),
        **{name: none.cast(COMMON[name]) for name in ("nsu", "data_recebimento", "cancelamento", "status", "estabelecimento", "lote", "valor_mdr")},
    }
    helpers = {"_auth", "_form", "_current", "_total", *(f"_raw_{k}" for k in range(len(DAYS_OF_REPORT))), *(f"_text_{name}" for name in TEXTS_OF_REPORT)}
    return own.select(*(c for c in own.columns if c not in helpers), *(c.alias(name) for name, c in out.items()))

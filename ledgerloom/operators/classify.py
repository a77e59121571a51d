"""Statuses, divergent fields, recommended actions and reasons of paired and unpaired rows, and the detail report.

Rows come as a full outer join of two aliased sides, s of the ledger and r of the acquirer; either may be absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import criterion, remaining
from ledgerloom.functions.installments import DIFFERENT, EXACT, SAME_REMAINING, UNKNOWN
from ledgerloom.functions.money import MONEY
from ledgerloom.operators import fallback
from ledgerloom.operators.assign import tolerance
from ledgerloom.operators.quality import WEAK, cancelled
from ledgerloom.operators.schema import COMPARED

MONEY_FIELDS = ("valor_bruto", "valor_liquido", "valor_mdr")
#: Fixed values from here on: statuses of divergent fields, kinds of match, actions and reasons.
STATUS_OF = {
    "autorizacao": "DIVERGENCIA_AUTORIZACAO", "nsu": "DIVERGENCIA_NSU", "estabelecimento": "REVISAO_MANUAL", "lote": "REVISAO_MANUAL",
    "valor_bruto": "DIVERGENCIA_VALOR_BRUTO", "valor_liquido": "DIVERGENCIA_VALOR_LIQUIDO", "valor_mdr": "DIVERGENCIA_MDR", "modalidade": "DIVERGENCIA_MODALIDADE",
    "bandeira": "DIVERGENCIA_BANDEIRA", "status": "DIVERGENCIA_STATUS", "data_venda": "DIVERGENCIA_DATA", "data_recebimento": "DIVERGENCIA_DATA", "data_vencimento": "DIVERGENCIA_DATA",
}
GROUP_AMBIGUOUS, GROUP_VALUE, GROUP_MATCHED = "AGRUPAMENTO_OS_AMBIGUO", "AGRUPAMENTO_OS_VALOR_DIVERGENTE", "CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO"
NOT_AT_ACQUIRER, NOT_IN_LEDGER = "NAO_ENCONTRADO_NA_REDE", "NAO_ENCONTRADO_NO_SHIFT"
TOLERATED, TOLERATED_ALONE, MATCHED = "DIVERGENCIA_TOLERADA_ATE_2_CENTAVOS", "CONCILIADO_COM_DIVERGENCIA_TOLERADA", "CONCILIADO"
BY_AUTH, BY_GROUP, GROUP_ALONE, LEFT_OVER = "AUTORIZACAO_COMPATIVEL", "AUTORIZACAO_NORMALIZADA_AGRUPAMENTO_SHIFT", "AGRUPAMENTO_OS_SEM_CORRESPONDENCIA_REDE", "SEM_CORRESPONDENCIA_NO_SHIFT"
NO_ACTION, MANUAL = "Sem ação necessária", "Revisão manual obrigatória"
ACTIONS = (
    (TOLERATED_ALONE, "Diferença de até R$ 0,02 aceita; manter para auditoria"),
    ("ERRO_CADASTRAL_SHIFT", "Corrigir cadastro no Shift"),
    (GROUP_AMBIGUOUS, MANUAL),
    (GROUP_VALUE, "Conferir soma das O.S. agrupadas"),
    ("AGRUPAMENTO_SHIFT_AMBIGUO", MANUAL),
    ("DUPLICIDADE_EXATA_SUSPEITA", "Revisar possível linha duplicada no Shift"),
    (fallback.REVIEW, "Revisar autorização divergente manualmente."),
    (fallback.AMBIGUOUS, "Revisar manualmente: múltiplos candidatos possíveis, sem correspondência automática."),
    ("DIVERGENCIA_PARCELA", "Verificar parcela"),
    (UNKNOWN, "Conferir parcela/quantidade de parcelas manualmente"),
    ("DIVERGENCIA_VALOR_BRUTO", "Verificar valor bruto"),
    (fallback.NOTHING, "Verificar se a venda foi processada ou lançada na unidade correta"),
    (NOT_AT_ACQUIRER, "Verificar se a venda foi processada ou lançada na unidade correta"),
    (NOT_IN_LEDGER, "Cadastrar ou justificar a transação no Shift"),
)
REASONS = {
    "ambiguous": "Existem múltiplas O.S. do Shift com a mesma autorização, mas campos críticos incompatíveis. Nenhum agrupamento automático foi feito.",
    "group_alone": "Múltiplas O.S. da Shift possuem a mesma autorização, mas não foi encontrada transação correspondente na Rede.",
    "group_several": "Há mais de uma transação da Rede com a mesma autorização para um agrupamento de múltiplas O.S. do Shift. Revisão manual necessária.",
    "group_installments": "Múltiplas O.S. com a mesma autorização encontraram transação na Rede, mas as parcelas são incompatíveis para conciliação automática.",
    BY_GROUP: "Múltiplas linhas da Shift com mesma autorização e campos críticos compatíveis foram somadas e conciliadas com uma única transação da Rede.",
    fallback.NOTHING: "Sem autorização compatível na Rede. Fallback por data e valor não permitido.",
    LEFT_OVER: "Autorização da Rede não encontrada em nenhuma linha do Shift.",
    fallback.REVIEW: "Possível correspondência 1 para 1 encontrada por valor bruto, valor líquido, data de venda, modalidade, bandeira e parcela compatível, porém a autorização é divergente. Revisão manual obrigatória.",
    fallback.AMBIGUOUS: "Sem autorização compatível e mais de uma transação corresponde por valor bruto, valor líquido, data de venda, modalidade, bandeira e parcela. Não é seguro parear automaticamente; revise manualmente.",
}
REASON_OF_INSTALLMENTS = {
    EXACT: "Parcela e quantidade de parcelas idênticas.",
    SAME_REMAINING: "Parcelas diferentes no bruto, mas equivalentes por parcelas restantes (possível pagamento misto na Shift, ex.: cartão + dinheiro/PIX).",
    DIFFERENT: "Saldo de parcelas restantes diferente entre Shift e Rede.",
    UNKNOWN: "Dados de parcela ausentes ou inválidos em um dos lados; não comparados automaticamente.",
}
ALERT_CRITERION = "VALOR_BRUTO+VALOR_LIQUIDO(TOLERANCIA)+DATA_VENDA+MODALIDADE+BANDEIRA+PARCELA"

#: What becomes of a row. PAIRED is a pair by authorisation; the others have fixed outputs: match type, statuses, fields,
#: reason, stage, level, alert criterion, whether the candidate is the only one.
PAIRED, CONFLICTING, SEVERAL = "paired", "conflicting", "several"
CASES = {
    CONFLICTING: (GROUP_AMBIGUOUS, GROUP_AMBIGUOUS, "agrupamento_shift", REASONS["ambiguous"], 0, None, None, None),
    SEVERAL: (GROUP_AMBIGUOUS, GROUP_AMBIGUOUS, "autorizacao", REASONS["group_several"], 0, None, None, None),
    GROUP_ALONE: (GROUP_ALONE, f"{NOT_AT_ACQUIRER},MULTIPLAS_OS_MESMA_AUTORIZACAO", "", REASONS["group_alone"], 0, None, None, None),
    fallback.REVIEW: (fallback.REVIEW, fallback.REVIEW, "autorizacao", REASONS[fallback.REVIEW], 1, "ALTA", ALERT_CRITERION, True),
    fallback.AMBIGUOUS: (fallback.AMBIGUOUS, f"{fallback.AMBIGUOUS},{NOT_AT_ACQUIRER}", "autorizacao", REASONS[fallback.AMBIGUOUS], 1, "AMBIGUA", ALERT_CRITERION, False),
    fallback.NOTHING: (fallback.NOTHING, NOT_AT_ACQUIRER, "", REASONS[fallback.NOTHING], 1, "SEM_CORRESPONDENCIA", None, False),
    LEFT_OVER: (LEFT_OVER, NOT_IN_LEDGER, "", REASONS[LEFT_OVER], 2, None, None, None),
}

TEXTS = "array<string>"


def texts(*values: Column | str | None) -> Column:
    """An array of the given texts, without nulls."""
    own = [F.lit(v) if isinstance(v, str) else v for v in values]
    if own and all(isinstance(v, str) for v in values):
        return F.array(*own).cast(TEXTS)
    return F.array_compact(F.array(*own)).cast(TEXTS) if own else F.array().cast(TEXTS)


def of_quality() -> Column:
    """Statuses that a ledger row's quality codes give."""
    codes, weak = F.col("s.codes"), F.array(*map(F.lit, WEAK))
    return texts(
        F.when(F.size(F.array_except(codes, weak)) > 0, F.lit("ERRO_CADASTRAL_SHIFT")),
        F.when(F.exists(codes, lambda c: c.contains("DUPLICAD")), F.lit("POSSIVEL_DUPLICIDADE")),
        F.when(F.col("s._repeated"), F.lit("DUPLICIDADE_EXATA_SUSPEITA")),
    )


def pair_criterion() -> Column:
    return criterion(F.col("s.parcela"), F.col("s.numero_parcelas"), F.col("r.parcela"), F.col("r.numero_parcelas"))


def divergences() -> tuple[Column, Column, Column]:
    """Of a pair: divergent fields, their statuses, and whether a difference was tolerated. A null on either side is no divergence."""
    fields, statuses, tolerated = [], [], F.lit(False)
    for f in COMPARED:
        if f in ("parcela", "numero_parcelas"):
            continue
        a, b = F.col(f"s.{f}"), F.col(f"r.{f}")
        differs = F.coalesce(a != b, F.lit(False))
        if f == "data_vencimento":
            differs = differs & F.col("s._comparar_data_vencimento")
        fields.append(F.when(differs, F.lit(f)))
        if f in MONEY_FIELDS:
            small = F.coalesce(F.abs(a - b) <= tolerance(), F.lit(False))
            tolerated = tolerated | (differs & small)
            differs = differs & ~small
        statuses.append(F.when(differs, F.lit(STATUS_OF[f])))
    return texts(*fields), texts(*statuses), tolerated


def by_case(case: Column, k: int, kind: str) -> Column:
    """What CASES has in place k for the case; null for pairs by authorisation."""
    return F.coalesce(*(F.when(case == name, F.lit(row[k]).cast(kind)) for name, row in CASES.items()), F.lit(None).cast(kind))


def stage(case: Column) -> Column:
    """The part of the report that rows of the case belong to."""
    return F.when(case == PAIRED, F.lit(0)).otherwise(by_case(case, 4, "int"))


def judged(joined: DataFrame, case: Column) -> DataFrame:
    """joined with case, statuses, fields, kind of match, reason and the like as columns _j_*. Each stage is a projection of its own.

    What only pairs by authorisation need is null for all other rows, which are most of a large report, and costs them nothing.
    """
    fields, field_statuses, tolerated = divergences()
    is_cancelled = cancelled(F.concat_ws(" ", "s.cancelamento", "r.cancelamento"))
    j = lambda name: F.col(f"_j_{name}")
    paired = lambda c: F.when(j("case") == PAIRED, c)
    first = {
        "how": F.when(j("case").isin(PAIRED, fallback.REVIEW), pair_criterion()), "field_names": paired(fields), "field_statuses": paired(field_statuses), "tolerated": paired(tolerated),
        "quality": F.when(F.col("s.ord").isNotNull(), of_quality()).otherwise(texts()), "cancelled": paired(is_cancelled),
    }
    own = joined.withColumn("_j_case", case).withColumns({f"_j_{k}": v for k, v in first.items()})

    # pairs by authorisation
    grouped, t = F.col("s._grouped"), j("tolerated")
    of_installments = F.when(j("how") == DIFFERENT, F.lit("DIVERGENCIA_PARCELA")).when(j("how") == UNKNOWN, F.lit(UNKNOWN)).when(j("how") == SAME_REMAINING, F.lit("CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES"))
    plain = F.concat(j("quality"), texts(of_installments), j("field_statuses"), texts(F.when(j("cancelled"), F.lit("CANCELAMENTO_CONTESTACAO"))))
    own = own.withColumns({"_j_found": paired(plain), "_j_all_fields": paired(F.concat(texts(F.when(j("how") == DIFFERENT, F.lit("parcela"))), j("field_names")))})
    values = F.array(F.lit("DIVERGENCIA_VALOR_BRUTO"), F.lit("DIVERGENCIA_VALOR_LIQUIDO"))
    of_group = F.when(grouped & F.arrays_overlap(j("found"), values), F.concat(F.filter(j("found"), lambda x: ~F.array_contains(values, x)), texts(GROUP_VALUE))).otherwise(j("found"))
    own = own.withColumns({"_j_found": paired(of_group), "_j_others": F.filter(j("all_fields"), lambda x: ~x.isin("valor_bruto", "data_venda"))})
    nothing = F.size(j("found")) == 0
    final = (
        F.when(nothing & grouped & t, texts(GROUP_MATCHED, TOLERATED))
        .when(nothing & grouped, texts(GROUP_MATCHED))
        .when(nothing & t, texts(TOLERATED_ALONE))
        .when(t, F.concat(j("found"), texts(TOLERATED)))
        .when(nothing, texts(MATCHED))
        .otherwise(j("found"))
    )
    blocked = grouped & (j("how") == DIFFERENT)  # a group whose instalments don't fit
    reason = F.lit(None).cast("string")
    for name, text in REASON_OF_INSTALLMENTS.items():
        reason = F.when(j("how") == name, F.lit(text)).otherwise(reason)
    by_auth = F.concat_ws(
        " ", F.lit("Autorização compatível."), reason,
        F.when(F.array_contains(j("all_fields"), "valor_bruto"), F.lit("Valor bruto divergente.")),
        F.when(F.array_contains(j("all_fields"), "data_venda"), F.lit("Data da venda divergente.")),
        F.when(F.size(j("others")) > 0, F.concat(F.lit("Outros campos divergentes: "), F.array_join(j("others"), ", "), F.lit("."))),
    )

    # the other cases have fixed outputs
    of_case = lambda k, kind: by_case(j("case"), k, kind)
    lists = lambda k: F.coalesce(*(F.when(j("case") == name, texts(*row[k].split(",")) if row[k] else texts()) for name, row in CASES.items()))
    fixed = F.when(j("case").isin(CONFLICTING, LEFT_OVER), lists(1)).otherwise(F.concat(j("quality"), lists(1)))
    fixed_fields = lists(2)

    pair = j("case") == PAIRED
    out = {
        "statuses": F.when(pair, F.when(blocked, F.concat(j("quality"), texts(GROUP_AMBIGUOUS))).otherwise(final)).otherwise(fixed).cast(TEXTS),
        "fields": F.when(pair, F.when(blocked, texts("parcela")).otherwise(j("all_fields"))).otherwise(fixed_fields).cast(TEXTS),
        "match_type": F.when(pair, F.when(blocked, F.lit(GROUP_AMBIGUOUS)).when(grouped, F.lit(BY_GROUP)).otherwise(F.lit(BY_AUTH))).otherwise(of_case(0, "string")),
        "reason": F.when(pair, F.when(blocked, F.lit(REASONS["group_installments"])).when(grouped, F.lit(REASONS[BY_GROUP])).otherwise(by_auth)).otherwise(of_case(3, "string")),
        "criterion": F.when(pair | (j("case") == fallback.REVIEW), j("how")), "level": of_case(5, "string"), "alert": of_case(6, "string"), "unique": of_case(7, "boolean"),
        "emit": F.coalesce("s.ord", "r.ord"), "stage": stage(j("case")),
    }
    return own.withColumns({f"_j_{k}": v for k, v in out.items()})


def action(statuses: Column) -> Column:
    fine = (F.size(statuses) > 0) & F.forall(statuses, lambda x: x.startswith("CONCILIADO") | (x == TOLERATED))
    out = F.when(fine, F.lit(NO_ACTION))
    for status, text in ACTIONS:
        out = out.when(F.array_contains(statuses, status), F.lit(text))
    return out.otherwise(F.lit(MANUAL))


def detail(rows: DataFrame) -> DataFrame:
    """The detail report, a row for each judged row; stage and emit give its order."""
    s, r = lambda c: F.col(f"s.{c}"), lambda c: F.col(f"r.{c}")
    has_s, has_r = F.col("s.ord").isNotNull(), F.col("r.ord").isNotNull()
    rows = rows.withColumn("_j_statuses", F.array_distinct("_j_statuses"))
    statuses = F.col("_j_statuses")
    rows = rows.withColumns({"_j_joined": F.array_join(statuses, " + "), "_j_todo": action(statuses)})
    joined, todo = F.col("_j_joined"), F.col("_j_todo")
    n_lines = F.when(has_s, F.coalesce(s("_linhas_agrupadas_shift"), F.lit(1)))
    grouped = lambda c, single: F.when(has_s, F.coalesce(s(c), single.cast("string")))
    line_ids = grouped("_rows_agrupadas", s("_row"))
    known = F.col("_j_criterion").isNotNull()
    out = {
        "tipo_correspondencia": F.col("_j_match_type"), "criterio_match": F.col("_j_match_type"), "status_comparacao": joined, "status_conciliacao": joined,
        "campos_divergentes": F.array_join(F.array_distinct("_j_fields"), ", "), "sugestao_acao": todo, "acao_recomendada": todo, "motivo": F.col("_j_reason"), "criterio_parcela": F.col("_j_criterion"),
        "parcelas_restantes_shift": F.when(known, remaining(s("parcela"), s("numero_parcelas"))), "parcelas_restantes_rede": F.when(known, remaining(r("parcela"), r("numero_parcelas"))),
        "parcelas_compativeis": F.when(known, F.col("_j_criterion").isin(EXACT, SAME_REMAINING)), "nivel_confianca": F.col("_j_level"), "criterio_alerta": F.col("_j_alert"), "unico_candidato": F.col("_j_unique"),
        "houve_agrupamento_shift": F.coalesce(s("_linhas_agrupadas_shift") > 1, F.lit(False)), "linhas_shift_agrupadas": n_lines, "ids_linhas_shift": line_ids,
        "codigos_conta_shift": grouped("_codigos_conta_agrupados", s("codigo_conta")), "codigos_registro_shift": grouped("_codigos_registro_agrupados", s("codigo_registro")),
        "autorizacoes_originais_shift": grouped("_autorizacoes_originais_agrupadas", s("raw_autorizacao")),
        "valores_brutos_originais_shift": grouped("_valores_brutos_originais_agrupados", s("valor_bruto")), "valores_liquidos_originais_shift": grouped("_valores_liquidos_originais_agrupados", s("valor_liquido")),
        "descricoes_originais_shift": grouped("_descricoes_originais_agrupadas", s("descricao")), "valor_bruto_shift_agrupado": s("valor_bruto"), "valor_liquido_shift_agrupado": s("valor_liquido"),
        "quantidade_os_agrupadas": n_lines, "lista_os_shift": grouped("_os_shift_agrupadas", s("os_shift")), "lista_codigos_conta_shift": grouped("_codigos_conta_agrupados", s("codigo_conta")),
        "lista_codigos_registro_shift": grouped("_codigos_registro_agrupados", s("codigo_registro")), "lista_linhas_originais_shift": line_ids,
        "criterio_agrupamento": s("_criterio_agrupamento"), "motivo_agrupamento": s("_motivo_agrupamento"),
        "data_shift_usada_para_match": F.coalesce(s("data_shift_usada_para_match"), s("data_venda")), "campo_data_shift_usado": F.when(has_s, F.coalesce(s("campo_data_shift_usado"), F.lit("data_venda"))),
        "data_rede_usada_para_match": r("data_venda"), "campo_data_rede_usado": F.when(has_r, F.lit("Data original da venda")),
        "rede_arquivo_origem": r("rede_arquivo_origem"), "rede_aba_origem": r("rede_aba_origem"), "rede_linha_original": F.coalesce(r("rede_linha_original"), r("_row")), "rede_data_relatorio": r("rede_data_relatorio"),
        "rede_data_recebimento": r("data_recebimento"), "rede_duplicado_entre_arquivos": r("rede_duplicado_entre_arquivos"), "rede_arquivos_duplicados": r("rede_arquivos_duplicados"), "criterio_deduplicacao_rede": r("criterio_deduplicacao_rede"),
    }
    for prefix, of in (("shift", s), ("rede", r)):
        for f in COMPARED:
            out[f"{prefix}_{f}_original"] = of(f"raw_{f}")
            out[f"{prefix}_{f}_normalizado"] = of(f)
        out[f"linha_{prefix}"] = of("_row")
    for f in MONEY_FIELDS:
        out[f"diferenca_{f}"] = (r(f) - s(f)).cast(MONEY)
    for prefix in ("shift", "rede"):
        out[f"autorizacao_{prefix}_original"], out[f"autorizacao_{prefix}_normalizada"] = out[f"{prefix}_autorizacao_original"], out[f"{prefix}_autorizacao_normalizado"]
        for short, f in (("valor_bruto", "valor_bruto"), ("valor_liquido", "valor_liquido"), ("data_venda", "data_venda"), ("modalidade", "modalidade"), ("bandeira", "bandeira"), ("parcela", "parcela"), ("qtd_parcelas", "numero_parcelas")):
            out[f"{short}_{prefix}"] = out[f"{prefix}_{f}_normalizado"]
    return rows.select(F.col("_j_stage").alias("stage"), F.col("_j_emit").alias("emit"), statuses.alias("statuses"), *(c.alias(name) for name, c in out.items()))

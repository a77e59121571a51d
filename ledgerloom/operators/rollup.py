"""Summaries, audit rows, ordering and the views on a finished detail report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Summary counts over the status text, as regular expressions.
COUNTS = {
    "total_conciliado": "^CONCILIADO", "total_divergencia_tolerada": "DIVERGENCIA_TOLERADA", "total_parcela_compativel_por_restantes": "CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES",
    "total_so_rede": "NAO_ENCONTRADO_NO_SHIFT", "total_so_shift": "NAO_ENCONTRADO_NA_REDE",
    "total_com_divergencia": "DIVERGENCIA|REVISAO_MANUAL|DADOS_PARCELA_INSUFICIENTES|REVISAR_AUTORIZACAO_DIVERGENTE|AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL|AGRUPAMENTO_SHIFT_AMBIGUO|AGRUPAMENTO_OS_AMBIGUO|AGRUPAMENTO_OS_VALOR_DIVERGENTE|DUPLICIDADE_EXATA_SUSPEITA",
    "total_agrupamento_shift_ambiguo": "AGRUPAMENTO_SHIFT_AMBIGUO|AGRUPAMENTO_OS_AMBIGUO", "total_revisar_autorizacao_divergente": "REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA",
    "total_ambiguo_sem_autorizacao": "AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL", "total_erro_cadastral_shift": "ERRO_CADASTRAL_SHIFT",
    "total_duplicidade": "POSSIVEL_DUPLICIDADE|DUPLICIDADE_EXATA_SUSPEITA", "total_cancelamento_contestacao": "CANCELAMENTO_CONTESTACAO",
}
#: Groups of divergences, in the order of the report, by a token that the status contains.
GROUPS = (
    ("AGRUPAMENTO_OS_AMBIGUO", "Agrupamentos ambíguos"),
    ("AGRUPAMENTO_OS_VALOR_DIVERGENTE", "Agrupamentos com valor divergente"),
    ("AGRUPAMENTO_SHIFT_AMBIGUO", "Agrupamentos ambíguos"),
    ("REVISAR_AUTORIZACAO_DIVERGENTE", "Autorizações divergentes para revisão"),
    ("DIVERGENCIA_AUTORIZACAO", "Divergências de autorização"),
    ("DIVERGENCIA_VALOR_BRUTO", "Divergências de valor bruto"),
    ("DIVERGENCIA_VALOR_LIQUIDO", "Divergências de valor líquido"),
    ("DIVERGENCIA_MDR", "Divergências de MDR"),
    ("DIVERGENCIA_PARCELA", "Divergências de parcela"),
    ("DADOS_PARCELA_INSUFICIENTES", "Dados de parcela insuficientes"),
    ("DIVERGENCIA_DATA", "Divergências de data"),
    ("DIVERGENCIA_BANDEIRA", "Divergências de bandeira"),
    ("DIVERGENCIA_MODALIDADE", "Divergências de modalidade"),
    ("NAO_ENCONTRADO_NA_REDE", "Encontradas somente no Shift"),
    ("NAO_ENCONTRADO_NO_SHIFT", "Encontradas somente na Rede"),
    ("POSSIVEL_DUPLICIDADE", "Possíveis duplicidades"),
    ("DUPLICIDADE_EXATA_SUSPEITA", "Duplicidades exatas suspeitas"),
    ("CONCILIADO_COM_DIVERGENCIA_TOLERADA", "Divergências toleradas até R$ 0,02"),
)
OTHER_GROUP = "Outras divergências"
RECONCILED = ("CONCILIADO", "CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES", "CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO", "CONCILIADO_POR_AGRUPAMENTO_SHIFT")
PANEL_ROWS = 200
SUM = "decimal(38,2)"


def status_counts(detail: DataFrame) -> DataFrame:
    """indicador and valor for each count over the status text: one pass, one row, then turned."""
    one = detail.agg(*(F.count_if(F.col("status_comparacao").rlike(p)).alias(k) for k, p in COUNTS.items()))
    return _turned(one, "bigint")


def _turned(one: DataFrame, kind: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("indicador"), F.col(c).cast(kind).alias("valor")) for c in one.columns))
    return one.select(F.inline(pairs))


def money_totals(acquirer: DataFrame, ledger: DataFrame) -> DataFrame:
    """indicador and valor of gross and net totals of both sides, after consolidation, and their differences."""
    zero = F.lit(0).cast(SUM)
    total = lambda df, side: df.agg(*(F.coalesce(F.sum(f"valor_{k}"), zero).cast(SUM).alias(f"valor_{k}_total_{side}") for k in ("bruto", "liquido")))
    both = total(acquirer, "rede").crossJoin(total(ledger, "shift"))  # one row each
    difference = {f"diferenca_total_valor_{k}": (F.col(f"valor_{k}_total_rede") - F.col(f"valor_{k}_total_shift")).cast(SUM) for k in ("bruto", "liquido")}
    return _turned(both.withColumns(difference), SUM)


def value_counts(ledger: DataFrame, column: str) -> DataFrame:
    return ledger.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("valor")).agg(F.count("*").alias("quantidade"))


def impact_totals(detail: DataFrame) -> DataFrame:
    one = detail.agg(F.coalesce(F.sum("impacto_financeiro_confirmado"), F.lit(0)).cast(SUM).alias("impacto_financeiro_confirmado"), F.coalesce(F.sum("valor_operacao_em_revisao"), F.lit(0)).cast(SUM).alias("valor_total_em_revisao"))
    return _turned(one, SUM)


def totals_by_status(detail: DataFrame) -> DataFrame:
    return detail.select(F.explode(F.split("status_conciliacao", r" \+ ")).alias("status")).groupBy("status").agg(F.count("*").alias("quantidade"))


def discard_reasons(discards: DataFrame) -> DataFrame:
    return discards.groupBy("origem", "arquivo_origem", "motivo_descarte").agg(F.count("*").alias("quantidade"))


def audit(counters: DataFrame, discards: DataFrame, per_file: DataFrame | None = None) -> DataFrame:
    """origem, indicador and valor: numeric counters of either side, discard reasons, and counts per file(indicador, arquivo, valor)."""
    kind = "decimal(38,2)"
    sides = counters.where(F.col("indicador").rlike("^(shift_|rede_)")).select(F.upper(F.substring_index("indicador", "_", 1)).alias("origem"), "indicador", F.col("valor").cast(kind).alias("valor"))
    reasons = discards.where("motivo_descarte is not null").groupBy("motivo_descarte").agg(F.count("*").cast(kind).alias("valor")).select(F.lit("GERAL").alias("origem"), F.concat(F.lit("motivo_descarte_"), "motivo_descarte").alias("indicador"), "valor")
    out = sides.union(reasons)
    if per_file is not None:
        out = out.union(per_file.select(F.lit("REDE"), F.concat_ws(":", "indicador", "arquivo"), F.col("valor").cast(kind)))
    return out


def group_of(status: Column) -> Column:
    """struct(rank, label) of the first group whose token the status contains."""
    out = F.struct(F.lit(len(GROUPS)).alias("rank"), F.lit(OTHER_GROUP).alias("label"))
    for k, (token, label) in reversed(list(enumerate(GROUPS))):
        out = F.when(F.coalesce(status, F.lit("")).contains(token), F.struct(F.lit(k).alias("rank"), F.lit(label).alias("label"))).otherwise(out)
    return out


def ordered(divergences: DataFrame, n: int | None = None) -> DataFrame:
    """divergences with grupo_divergencia, by group, impact, value in review and authorisation; the first n where n is given."""
    group = group_of(F.col("status_comparacao"))
    auth = F.coalesce(F.nullif(F.col("shift_autorizacao_normalizado"), F.lit("")), "rede_autorizacao_normalizado", F.lit(""))
    own = divergences.withColumns({"grupo_divergencia": group["label"], "_rank": group["rank"], "_auth": auth})
    by = [F.col("_rank"), F.coalesce("impacto_financeiro_confirmado", F.lit(0)).desc(), F.coalesce("valor_operacao_em_revisao", F.lit(0)).desc(), F.col("_auth"), F.col("stage"), F.col("emit")]
    out = own.orderBy(*by)
    return (out.limit(n) if n is not None else out).drop("_rank", "_auth")


def panels(detail: DataFrame, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reconciled rows and divergences: the status is, or isn't, exactly one of RECONCILED. file: only rows of that acquirer file."""
    own = detail if file is None else detail.where(F.col("rede_arquivo_origem") == file)
    fine = F.col("status_comparacao").isin(*RECONCILED)
    return own.where(fine), own.where(~fine)


def reconciled_authorizations(reconciled: DataFrame) -> DataFrame:
    auth = F.coalesce(F.nullif(F.col("autorizacao_shift_normalizada"), F.lit("")), F.nullif(F.col("autorizacao_rede_normalizada"), F.lit("")))
    return reconciled.select(auth.alias("autorizacao")).where("autorizacao is not null").distinct().orderBy("autorizacao")


def acquirer_files(detail: DataFrame) -> DataFrame:
    return detail.select(F.col("rede_arquivo_origem").alias("arquivo")).where("arquivo != ''").distinct().orderBy("arquivo")


def numbered(shown: DataFrame) -> DataFrame:
    """An ordered panel of at most PANEL_ROWS rows with posicao, from 1."""
    auth = F.coalesce(F.nullif(F.col("shift_autorizacao_normalizado"), F.lit("")), "rede_autorizacao_normalizado", F.lit(""))
    by = [group_of(F.col("status_comparacao"))["rank"], F.coalesce("impacto_financeiro_confirmado", F.lit(0)).desc(), F.coalesce("valor_operacao_em_revisao", F.lit(0)).desc(), auth, F.col("stage"), F.col("emit")]
    return shown.withColumn("posicao", F.row_number().over(Window.orderBy(*by)).cast("bigint"))


def with_group_breaks(shown: DataFrame) -> DataFrame:
    """A shown panel (at most PANEL_ROWS ordered rows) with whether each row begins a new group."""
    order = Window.orderBy("posicao")
    return shown.withColumn("inicia_grupo", ~F.lag("grupo_divergencia").over(order).eqNullSafe(F.col("grupo_divergencia")))

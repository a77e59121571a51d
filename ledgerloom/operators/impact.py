"""The financial impact of each detail row: confirmed, or in review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.operators import classify, fallback


def with_impact(detail: DataFrame) -> DataFrame:
    """detail with the operation's values, impacto_financeiro_confirmado and valor_operacao_em_revisao. The first rule that holds decides.

    diferenca_valor_bruto and diferenca_valor_liquido become absolute values here.
    """
    zero = F.lit(0).cast(MONEY)
    has = lambda status: F.array_contains("statuses", status)
    gross = F.abs(F.col("valor_bruto_shift") - F.col("valor_bruto_rede")).cast(MONEY)
    net = F.abs(F.col("valor_liquido_shift") - F.col("valor_liquido_rede")).cast(MONEY)
    of_ledger, of_acquirer = F.coalesce("valor_liquido_shift", "valor_bruto_shift"), F.coalesce("valor_liquido_rede", "valor_bruto_rede")
    alone_l, alone_a, review = has(classify.NOT_AT_ACQUIRER), has(classify.NOT_IN_LEDGER), has(fallback.REVIEW)
    ambiguous = has(classify.GROUP_AMBIGUOUS) | has(fallback.AMBIGUOUS)
    either = F.when(net != 0, net).when(gross != 0, gross).otherwise(zero)
    confirmed = (
        F.when(alone_l, F.coalesce(of_ledger, zero))
        .when(alone_a, F.coalesce(of_acquirer, zero))
        .when(review | ambiguous, zero)
        .when(has("DIVERGENCIA_VALOR_LIQUIDO"), F.coalesce(net, zero))
        .when(has("DIVERGENCIA_VALOR_BRUTO"), F.coalesce(gross, zero))
        .otherwise(either)
    )
    in_review = F.when(alone_l | alone_a, zero).when(review, F.coalesce(of_ledger, of_acquirer, zero)).when(ambiguous, F.coalesce(of_ledger, zero) + F.coalesce(of_acquirer, zero)).otherwise(zero)
    operation = F.when(alone_l, of_ledger).when(alone_a, of_acquirer).otherwise(F.coalesce(of_ledger, of_acquirer))
    return detail.withColumns({
        "diferenca_valor_bruto": gross, "diferenca_valor_liquido": net, "valor_operacao_shift": of_ledger, "valor_operacao_rede": of_acquirer,
        "valor_operacao_impacto": operation, "impacto_financeiro_confirmado": confirmed.cast(MONEY), "valor_operacao_em_revisao": in_review.cast(MONEY),
    })

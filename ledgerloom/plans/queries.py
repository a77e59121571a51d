"""The registered queries of the reconciliation: each applies its operator to the whole test tables (see plans/sides.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import functions as L
from ledgerloom.operators import assign, consolidate, fallback, history, prepare, quality, rollup, schema
from ledgerloom.operators.keeping import keep, keep_but, once
from ledgerloom.plans import matching, sides
from ledgerloom.plans.oracle import ORACLE_SQL  # noqa: F401  re-exported beside QUERIES

COMPANY = "FILIAL A"
QUERIES = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _acquirer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and discards."""
    return prepare.partitioned(sides.acquirer(spark, sf_dir), "REDE")


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, those of other companies, and discards."""
    own, other = prepare.of_company(sides.ledger(spark, sf_dir), COMPANY)
    own, gone = prepare.partitioned(own, "SHIFT")
    return own, other, gone


def _discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_acquirer = _acquirer(spark, sf_dir)[1]  # first: side L is then made of it
    _, other, gone = _ledger(spark, sf_dir)
    return prepare.all_discards(other, gone, of_acquirer)


def _match(spark: SparkSession, sf_dir: str) -> matching.Result:
    """The match that all queries of its results read, made once for the application."""

    def make() -> matching.Result:
        a, l = _acquirer(spark, sf_dir)[0], _ledger(spark, sf_dir)[0]  # noqa: E741
        result = matching.match(a, l, kept=True, consolidated=_consolidated(spark, sf_dir), coded=lambda: _coded(spark, sf_dir))
        result.discards = _discards(spark, sf_dir)
        one = lambda df, name: df.agg(F.count("*").alias("valor")).select(F.lit(name).alias("indicador"), "valor")
        result.counters = one(a, "rede_transacoes_enviadas_para_matching").union(one(l, "shift_linhas_validas_para_conciliacao"))
        return result

    return once(spark, "match", sides._inputs(sf_dir), make)


def _consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda: keep_but(consolidate.consolidated(schema.ledger(_ledger(spark, sf_dir)[0])), "consolidated", sides.constants_of_ledger(spark, sf_dir))
    return once(spark, "consolidated", sides._inputs(sf_dir), make)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated ledger rows with their quality codes."""
    return once(spark, "coded", sides._inputs(sf_dir), lambda: quality.with_codes(_consolidated(spark, sf_dir)))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ledger rows that take part in assignment, and the acquirer's."""
    a = schema.acquirer(_acquirer(spark, sf_dir)[0])  # first: side L is then made of it
    return _consolidated(spark, sf_dir).where("not _ambiguous"), a


# --- scalar rules ---------------------------------------------------------------------------------------------------


@_query
def norm_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.staged(sides.raw_ledger(spark, sf_dir).select("ord", "autorizacao"), {"a": (L.authorization_rule(), F.col("autorizacao"))})
    return L.staged(own.select("ord", "a.value", "a.error"), {"auth_key": (L.MATCH_KEY, F.col("value"))})


@_query
def norm_nsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.staged(sides.raw_acquirer(spark, sf_dir).select("ord", "nsu"), {"nsu": (L.NSU, F.col("nsu"))})


@_query
def norm_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sides.raw_ledger(spark, sf_dir).select("ord", F.col("valor_bruto_original").alias("valor_bruto"), "valor_liquido")
    return L.staged(raw, {c: (L.AMOUNT, F.col(c)) for c in ("valor_bruto", "valor_liquido")})


@_query
def norm_instalment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.staged(sides.raw_ledger(spark, sf_dir).select("ord", "parcela"), {"parcela": (L.installment_rule(), F.col("parcela")), "numero_parcelas": (L.installment_rule(1), F.col("parcela"))})
    return own.withColumn("restantes", L.remaining(F.col("parcela"), F.col("numero_parcelas")))


@_query
def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.staged(sides.raw_ledger(spark, sf_dir).select("ord", "data_venda"), {"data_venda": (L.DATE, F.col("data_venda"))})


@_query
def brand_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.staged(sides.raw_acquirer(spark, sf_dir).select("ord", "bandeira", "modalidade"), {"bandeira": (L.BRAND, F.col("bandeira")), "modalidade": (L.MODALITY, F.col("modalidade"))})


@_query
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 4
    text = F.concat(F.when(k == 0, "São José ").when(k == 1, "crédito à vista ").when(k == 2, "Ünïted Ñandú ").otherwise("Ação Ímpar "), "c_name")
    return customer.select("c_custkey", L.fold(text).alias("folded"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@_query
def payment_form_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "visa").when(k % 3 == 1, "Master").otherwise("ELO")
    text = F.when(k % 4 == 0, "PIX ITAU (Jn)").when(k % 4 == 1, F.concat(F.lit("REDE débito "), name)).otherwise(F.concat(F.lit("rede "), (k % 12 + 1).cast("string"), F.lit("x "), name))
    parsed = _orders(spark, sf_dir).select("o_orderkey", L.payment_form(text).alias("p"))
    return parsed.select("o_orderkey", F.col("p.operator").alias("operadora"), F.col("p.modality").alias("modalidade"), F.col("p.brand").alias("bandeira"), F.col("p.installments").alias("parcelas"))


@_query
def extract_os(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "sem ordem ").otherwise("Venda os:  022-"), F.col("o_custkey").cast("string"), F.lit(" (balcão)"))
    return _orders(spark, sf_dir).select("o_orderkey", L.service_order(text).alias("os_shift"))


@_query
def card_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("o_orderkey") % 4 == 0, "PIX").otherwise(" rede 1X VISA")
    kind = F.when(F.col("o_orderstatus") == "F", "Cartão de Crédito/Débito").otherwise("Outros")
    rows = _orders(spark, sf_dir).withColumns({"Espécie": kind, "Forma de pagamento/cobrança": form})
    return prepare.card_scope(rows)[0].select("o_orderkey")


# --- before matching ------------------------------------------------------------------------------------------------


@_query
def valid_discard_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discards(spark, sf_dir).select("origem", "motivo_descarte", "numero_linha_original")


@_query
def discard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = rollup.discard_reasons(_discards(spark, sf_dir))
    return reasons.groupBy("origem", "motivo_descarte").agg(F.sum("quantidade").alias("quantidade"))


@_query
def unit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.of_company(sides.ledger(spark, sf_dir), COMPANY)[0].select("ord", "empresa")


@_query
def context_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.context_values(_acquirer(spark, sf_dir)[0])


@_query
def cross_file_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sides.acquirer(spark, sf_dir)
    again = a.where(F.floor(F.col("ord") / 100) % 13 == 0).withColumns({"ord": F.col("ord") + (1 << 62), "rede_arquivo_origem": F.lit("c.csv")})
    return prepare.deduplicated(schema.acquirer(a.unionByName(again)))[0].select("ord", "rede_arquivo_origem", "rede_duplicado_entre_arquivos")


# --- the ledger side ------------------------------------------------------------------------------------------------


@_query
def split_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _consolidated(spark, sf_dir).where("_grouped")
    return merged.select("ord", F.col("_linhas_agrupadas_shift").alias("linhas_agrupadas"), "valor_bruto", "valor_liquido", F.col("_os_shift_agrupadas").alias("lista_os"), F.col("_rows_agrupadas").alias("lista_linhas"))


@_query
def ambiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.flagged(schema.ledger(_ledger(spark, sf_dir)[0])).where("_ambiguous").select("ord", F.col("_ambiguous").alias("ambigua"))


@_query
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.flagged(schema.ledger(_ledger(spark, sf_dir)[0])).where("_repeated").select("ord", F.col("_repeated").alias("repetida"))


@_query
def quality_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_coded(spark, sf_dir)).select("linha_shift", "problema")


@_query
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_duplicates(_consolidated(spark, sf_dir)).select("ord", *(F.col(code).alias(code.lower()) for code in quality.DUPLICATES))


# --- matching -------------------------------------------------------------------------------------------------------


@_query
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assign.candidate_scores(*_both(spark, sf_dir))
    return pairs.select("s_ord", "r_ord", F.col("score.value").alias("by_value"), F.col("score.installments").alias("rank"), F.col("score.nsu").alias("by_nsu"), F.col("score.date").alias("by_date"))


@_query
def greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.assigned(*_both(spark, sf_dir))


def _second(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the second stage pairs: ledger rows without an outcome, and acquirer rows, less those that are taken."""
    l, a = _both(spark, sf_dir)  # noqa: E741
    outcome = keep(assign.assigned(l, a), "outcome")
    with_one = outcome.where(F.col("outcome") != assign.NONE_FREE).select(F.col("s_ord").alias("ord"))
    taken = outcome.where("r_ord is not null").select(F.col("r_ord").alias("ord"))
    return l.where("not _grouped").join(with_one, "ord", "left_anti"), a, taken


@_query
def secondary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.candidates(*_second(spark, sf_dir))


@_query
def unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback.classified(*_second(spark, sf_dir))


@_query
def field_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).detail.where("campos_divergentes != ''").select("linha_shift", "linha_rede", F.col("campos_divergentes").alias("campos"))


@_query
def status_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).detail.select("stage", "emit", "linha_shift", "linha_rede", "tipo_correspondencia", "status_conciliacao")


@_query
def recommended_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).detail.select("linha_shift", "linha_rede", "acao_recomendada")


@_query
def ledger_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).not_at_acquirer().select("linha_shift", "status_conciliacao")


@_query
def acquirer_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).not_in_ledger().select("linha_rede", "status_conciliacao")


@_query
def financial_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).detail.select("linha_shift", "linha_rede", "impacto_financeiro_confirmado", "valor_operacao_em_revisao")


# --- summaries and views --------------------------------------------------------------------------------------------


@_query
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals_by_status(_match(spark, sf_dir).detail)


@_query
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.status_counts(_match(spark, sf_dir).detail)


@_query
def money_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.money_totals(_acquirer(spark, sf_dir)[0], _consolidated(spark, sf_dir))


@_query
def impact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.impact_totals(_match(spark, sf_dir).detail)


@_query
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _consolidated(spark, sf_dir)
    own = [rollup.value_counts(rows, c).select(F.lit(c).alias("campo"), "valor", "quantidade") for c in ("bandeira", "modalidade")]
    return own[0].union(own[1])


@_query
def divergence_order_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first panel of divergences: the row limit is the feature."""
    shown = rollup.ordered(rollup.panels(_match(spark, sf_dir).detail)[1], rollup.PANEL_ROWS)
    return rollup.numbered(shown).select("posicao", "grupo_divergencia", "linha_shift", "linha_rede")


@_query
def reconciled_authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.reconciled_authorizations(rollup.panels(_match(spark, sf_dir).detail)[0])


@_query
def audit_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir).audit()


@_query
def history_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reconciliations of the unit of their customer's nation."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "nation"))
    units = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nome"))
    runs = _orders(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("unidade_id"), F.col("o_orderdate").cast("date").alias("data_conciliacao"), F.col("o_orderdate").alias("criado_em")
    )
    return history.listed(runs, units, start="1995-01-01", end="1996-12-31").select("id", "unidade", "data_conciliacao")


@_query
def unit_delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "nation"))
    runs = _orders(spark, sf_dir).join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("unidade_id"))
    return history.usage(nation.select(F.col("n_nationkey").alias("id")), runs)

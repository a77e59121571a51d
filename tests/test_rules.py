"""Impact, order of divergences, quality codes, context of a report, and settings shared by threads."""

import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import impact, keeping, prepare, quality, rollup, schema
from ledgerloom.sources.headers import CANONICAL

# status, gross and net of the ledger, gross and net of the acquirer, confirmed, in review
IMPACTS = [
    ("NAO_ENCONTRADO_NA_REDE", "100.00", "95.00", None, None, "95.00", "0"),
    ("NAO_ENCONTRADO_NA_REDE", "100.00", None, None, None, "100.00", "0"),
    ("NAO_ENCONTRADO_NO_SHIFT", None, None, "50.00", "48.00", "48.00", "0"),
    ("DIVERGENCIA_VALOR_LIQUIDO", None, "100.00", None, "90.00", "10.00", "0"),
    ("DIVERGENCIA_VALOR_BRUTO", "100.00", None, "80.00", None, "20.00", "0"),
    ("DIVERGENCIA_DATA", "100.00", "95.00", "100.00", "95.00", "0", "0"),
    ("DIVERGENCIA_DATA", None, "100.00", None, "90.00", "10.00", "0"),
    ("REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA", "77.00", "75.19", None, None, "0", "75.19"),
    ("CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO", "69.00", None, "69.00", None, "0", "0"),
    ("AGRUPAMENTO_OS_AMBIGUO", None, "30.00", None, None, "0", "30.00"),
    ("AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL", None, "50.00", None, "48.00", "0", "98.00"),
    ("REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA", None, "1000.00", None, None, "0", "1000.00"),
    ("CONCILIADO", None, None, None, None, "0", "0"),
    ("DIVERGENCIA_VALOR_LIQUIDO + DIVERGENCIA_VALOR_BRUTO", "10.00", "9.00", "12.00", "9.50", "0.50", "0"),
    ("DIVERGENCIA_VALOR_LIQUIDO", "10.00", None, "12.00", "9.50", "0", "0"),
]


def test_impacts(spark):
    money = "decimal(28,2)"
    names = ("valor_bruto_shift", "valor_liquido_shift", "valor_bruto_rede", "valor_liquido_rede")
    given = spark.createDataFrame([(k, *row) for k, row in enumerate(IMPACTS)], f"k int, status string, {', '.join(f'{n} string' for n in names)}, confirmed string, review string")
    own = given.select("k", F.split("status", r" \+ ").alias("statuses"), *(F.col(n).cast(money).alias(n) for n in names), F.col("confirmed").cast(money), F.col("review").cast(money))
    rows = impact.with_impact(own).orderBy("k").collect()
    assert [(r["impacto_financeiro_confirmado"], r["valor_operacao_em_revisao"]) for r in rows] == [(r["confirmed"], r["review"]) for r in rows]
    same_values, nothing = rows[5], rows[12]
    assert (same_values["valor_operacao_shift"], same_values["valor_operacao_rede"]) == (Decimal("95.00"), Decimal("95.00"))  # seen without any impact
    assert (rows[3]["diferenca_valor_liquido"], rows[4]["diferenca_valor_bruto"]) == (Decimal("10.00"), Decimal("20.00"))
    assert (nothing["valor_bruto_shift"], nothing["diferenca_valor_bruto"], nothing["valor_operacao_impacto"]) == (None, None, None)


def test_divergences_come_by_group_impact_and_value_in_review(spark):
    given = [("NAO_ENCONTRADO_NO_SHIFT", None, 10), ("DIVERGENCIA_DATA", None, 20), ("NAO_ENCONTRADO_NO_SHIFT", None, 30), ("DIVERGENCIA_DATA", None, 50), ("DIVERGENCIA_VALOR_BRUTO", 2, None), ("DIVERGENCIA_NSU", 9, None), (None, None, None)]
    rows = spark.createDataFrame([(0, k, *row, None, None) for k, row in enumerate(given)], "stage int, emit int, status_comparacao string, impacto_financeiro_confirmado int, valor_operacao_em_revisao int, shift_autorizacao_normalizado string, rede_autorizacao_normalizado string")
    got = [(r["grupo_divergencia"], r["emit"]) for r in rollup.ordered(rows).collect()]
    assert got == [("Divergências de valor bruto", 4), ("Divergências de data", 3), ("Divergências de data", 1), ("Encontradas somente na Rede", 2), ("Encontradas somente na Rede", 0), ("Outras divergências", 5), ("Outras divergências", 6)]
    assert [r["emit"] for r in rollup.ordered(rows, 2).collect()] == [4, 3]


FIELDS = ("autorizacao", "nsu", "valor_bruto_original", "parcela", "numero_parcelas", "bandeira", "modalidade", "status", "cancelamento")
LINE = {"autorizacao": "123456", "nsu": "111", "valor_bruto_original": "10,00", "parcela": "1", "numero_parcelas": "1", "bandeira": "Visa", "modalidade": "Crédito", "status": "paga", "cancelamento": None}


def test_quality_codes_and_their_classes(spark):
    lines = [
        {"autorizacao": "55040"}, {"autorizacao": "55040"},  # the same payment twice
        {"nsu": "112"}, {"nsu": "222", "valor_bruto_original": "20,00"},  # one authorisation, two payments
        {"autorizacao": "619531", "nsu": "31", "valor_bruto_original": "0", "cancelamento": "cancelamento"}, {"autorizacao": "619532", "nsu": "32", "valor_bruto_original": "0"},
        {"autorizacao": "1234567", "nsu": "3#3"}, {k: None for k in FIELDS},
    ]
    given = spark.createDataFrame([(k, k, *(LINE | line).values()) for k, line in enumerate(lines)], f"ord bigint, _line bigint, {', '.join(f'{f} string' for f in LINE)}")
    rows = quality.with_codes(keeping.keep(schema.ledger(schema.normalized(given, "shift", {f: f for f in FIELDS}, tuple(CANONICAL)))))
    codes = [r["codes"] for r in rows.orderBy("ord").collect()]
    assert codes[0] == codes[1] == ["AUTORIZACAO_DUPLICADA", "NSU_DUPLICADO", "PAGAMENTO_DUPLICADO"]
    assert codes[2] == codes[3] == ["AUTORIZACAO_DUPLICADA"] and codes[4] == [] and codes[5] == ["VALOR_ZERADO"]
    assert codes[6] == ["AUTORIZACAO_TAMANHO_INVALIDO", "NSU_FORMATO_INVALIDO"]
    assert codes[7] == ["AUTORIZACAO_VAZIA", "NSU_VAZIO", "VALOR_VAZIO", "PARCELA_VAZIA", "NUMERO_PARCELAS_VAZIO", "BANDEIRA_VAZIA", "MODALIDADE_VAZIA", "STATUS_VAZIO"]
    kinds = {r["problema"]: r["classificacao"] for r in quality.report(rows).collect()}
    assert kinds["PAGAMENTO_DUPLICADO"] == "ERRO_CADASTRAL_SHIFT" and kinds["AUTORIZACAO_DUPLICADA"] == "ALERTA_CADASTRAL_SHIFT"


def test_context_of_a_report(spark, monkeypatch):
    kind = "data_recebimento date, estabelecimento string, nome_estabelecimento string"
    rows = spark.createDataFrame([("2025-12-01", f" e{k} ", "Loja") for k in range(5)] + [(None, None, "")], kind.replace("date", "string")).withColumn("data_recebimento", F.to_date("data_recebimento"))
    assert prepare.acquirer_context(rows, "2025-12-01", "e4") == {"datas_recebimento": ["2025-12-01"], "estabelecimentos": ["E0", "E1", "E2", "E3", "E4"], "nomes_estabelecimento": ["Loja"]}
    monkeypatch.setattr(prepare, "SHOWN", 2)
    assert prepare.acquirer_context(rows, "2025-12-01", "e4")["estabelecimentos"] == ["E0", "E1"]  # e4 isn't shown, but found
    with pytest.raises(ValueError, match=r"selecionada \(E9\).* E0, E1\."):
        prepare.acquirer_context(rows, "2025-12-01", "e9")
    with pytest.raises(ValueError, match="data selecionada"):
        prepare.acquirer_context(rows, "2025-12-02")
    assert prepare.acquirer_context(rows.limit(0), "2025-12-02", "e9") == {"datas_recebimento": [], "estabelecimentos": [], "nomes_estabelecimento": []}
    assert prepare.acquirer_context(rows.where("estabelecimento is null"), "2025-12-02", "e9")["nomes_estabelecimento"] == []
    assert {tuple(r) for r in prepare.context_values(rows).collect()} == {("data_recebimento", "2025-12-01"), ("nome_estabelecimento", "Loja"), *(("estabelecimento", f"E{k}") for k in range(5))}


def test_settings_stay_while_another_thread_writes(spark):
    name = "spark.sql.unionOutputPartitioning"
    before, inside, go_on = spark.conf.get(name, None), threading.Event(), threading.Event()

    def writer():
        with keeping.own_settings(spark):
            inside.set()
            go_on.wait(60)

    thread = threading.Thread(target=writer)
    thread.start()
    inside.wait(60)
    with keeping.own_settings(spark):
        pass
    assert spark.conf.get(name) == "false"  # the other one is still at it
    go_on.set()
    thread.join()
    assert spark.conf.get(name, None) == before

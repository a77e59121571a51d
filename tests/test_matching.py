"""Small hand-made sides: what the detail report must say."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import schema
from ledgerloom.plans import matching
from ledgerloom.sources import delimited, export
from ledgerloom.sources.headers import CANONICAL

FIELDS = {"autorizacao": "autorizacao", "valor_bruto_original": "bruto", "valor_liquido": "liquido", "parcela": "parcela", "bandeira": "bandeira", "modalidade": "modalidade", "status": "status", "data_venda": "dia"}
BASE = {"autorizacao": "055040", "bruto": "10,00", "liquido": None, "parcela": "1/1", "bandeira": "Visa", "modalidade": "Crédito", "status": "paga", "dia": "2025-11-26", "os_shift": None, "codigo_registro": None}
KIND = ", ".join(f"{c} string" for c in BASE)


def side(spark, source, *rows):
    data = [tuple((BASE | r).values()) for r in rows]
    df = spark.createDataFrame([(k, k, *x) for k, x in enumerate(data)], f"ord bigint, _line bigint, {KIND}")
    return schema.normalized(df, source, FIELDS, tuple(CANONICAL), ("os_shift", "codigo_registro") if source == "shift" else ())


def statuses(spark, acquirer, ledger):
    detail = matching.match(side(spark, "rede", *acquirer), side(spark, "shift", *ledger)).detail
    return [r["status_conciliacao"] for r in detail.orderBy("stage", "emit").collect()]


def test_leading_zeros_match(spark):
    assert statuses(spark, [{}], [{"autorizacao": "55040"}]) == ["CONCILIADO"]


def test_gross_value_differs(spark):
    assert statuses(spark, [{}], [{"bruto": "11,00"}]) == ["DIVERGENCIA_VALOR_BRUTO"]


def test_two_cents_are_tolerated(spark):
    assert statuses(spark, [{"bruto": "10,02"}], [{}]) == ["CONCILIADO_COM_DIVERGENCIA_TOLERADA"]


def test_remaining_installments(spark):
    assert statuses(spark, [{"parcela": "2/2"}], [{"parcela": "3/3"}]) == ["CONCILIADO_COM_PARCELA_COMPATIVEL_POR_RESTANTES"]
    assert statuses(spark, [{"parcela": "2/2"}], [{"parcela": "2/3"}]) == ["DIVERGENCIA_PARCELA"]


def test_no_partner_on_either_side(spark):
    assert statuses(spark, [{"autorizacao": "111111"}], [{"autorizacao": "222222"}]) == ["NAO_ENCONTRADO_NA_REDE", "NAO_ENCONTRADO_NO_SHIFT"]


def test_split_orders_are_summed(spark):
    got = statuses(spark, [{"bruto": "69,00"}], [{"bruto": "34,50", "os_shift": "OS1"}, {"bruto": "34,50", "os_shift": "OS2"}])
    assert got == ["CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO"]


def test_conflicting_orders_are_ambiguous(spark):
    got = statuses(spark, [{"bruto": "69,00"}], [{"os_shift": "OS1"}, {"os_shift": "OS2", "bandeira": "Elo"}])
    assert got == ["AGRUPAMENTO_OS_AMBIGUO", "AGRUPAMENTO_OS_AMBIGUO", "NAO_ENCONTRADO_NO_SHIFT"]


def test_groups_of_service_orders(spark):
    """Several authorisations in one match, each a case of its own; values differ so that the second stage finds nothing."""
    row = lambda auth, value, net, parcela="1/1", **more: {"autorizacao": auth, "bruto": value, "liquido": net, "parcela": parcela, **more}
    acquirer = [
        row("0680826", "71,50", "69,82", "1/2"), row("0195933", "100,00", "100,00"), row("0195934", "200,00", "200,00", "1/2"),
        row("0195935", "300,00", "300,00"), row("0195937", "500,00", "500,00"), row("0195938", "600,00", "600,00"),
    ]
    ledger = [
        row("680826", "13,00", "12,69", "1/2", os_shift="OS1"), row("680826", "58,50", "57,13", "1/2", os_shift="OS2"),
        row("195933", "50,00", "50,00", os_shift="OS1"), row("195933", "30,00", "30,00", os_shift="OS2"), row("195933", "19,00", "19,00", os_shift="OS3"),
        row("195934", "100,00", "100,00", "1/2", os_shift="OS1"), row("195934", "100,00", "100,00", "2/2", os_shift="OS2"),
        row("195935", "150,00", "150,00", os_shift="OS1", codigo_registro="REG1"), row("195935", "150,00", "150,00", os_shift="OS1", codigo_registro="REG1"),
        row("195936", "400,00", "400,00", os_shift="OS1"), row("195936", "400,00", "400,00", os_shift="OS2"),
        row("195937", "500,00", "500,00"), row("195938", "600,00", "600,00"),
    ]
    both = F.col("autorizacao") == "195938"
    files = {
        "rede_arquivo_origem": F.when(F.col("autorizacao") == "195937", "b.csv").otherwise("a.csv"), "rede_duplicado_entre_arquivos": both,
        "rede_arquivos_duplicados": F.when(both, "a.csv | b.csv"),
    }
    result = matching.match(side(spark, "rede", *acquirer).withColumns(files), side(spark, "shift", *ledger))
    found = {}
    for r in result.detail.orderBy("stage", "emit").collect():
        found.setdefault(r["autorizacao_shift_normalizada"] or r["autorizacao_rede_normalizada"], []).append(r)
    summed, differs, instalments, exact, alone, second, repeated = (found[k] for k in ("680826", "195933", "195934", "195935", "195936", "195937", "195938"))
    assert [(r["status_comparacao"], r["valor_bruto_shift_agrupado"], r["valor_liquido_shift_agrupado"], r["lista_os_shift"], r["linhas_shift_agrupadas"]) for r in summed] == [("CONCILIADO_POR_AGRUPAMENTO_OS_MESMA_AUTORIZACAO", Decimal("71.50"), Decimal("69.82"), "OS1 | OS2", 2)]
    assert len(differs) == 1 and "AGRUPAMENTO_OS_VALOR_DIVERGENTE" in differs[0]["status_comparacao"]
    assert (differs[0]["valor_liquido_shift_agrupado"], differs[0]["valor_liquido_rede"], differs[0]["diferenca_valor_liquido"]) == (Decimal("99.00"), Decimal("100.00"), Decimal("1.00"))
    assert ["AGRUPAMENTO_OS_AMBIGUO" in r["status_comparacao"] for r in instalments if r["linha_shift"] is not None] == [True, True]
    assert any("DUPLICIDADE_EXATA_SUSPEITA" in r["status_comparacao"] for r in exact)
    assert len(alone) == 1 and all(x in alone[0]["status_comparacao"] for x in ("NAO_ENCONTRADO_NA_REDE", "MULTIPLAS_OS_MESMA_AUTORIZACAO"))
    assert [(r["status_comparacao"], r["rede_arquivo_origem"]) for r in second] == [("CONCILIADO", "b.csv")]
    assert [(r["rede_duplicado_entre_arquivos"], r["rede_arquivos_duplicados"]) for r in repeated] == [(True, "a.csv | b.csv")]


def test_second_stage_pairs_are_reviewed(spark):
    got = statuses(spark, [{"autorizacao": "111111", "liquido": "9,00"}], [{"autorizacao": "222222", "liquido": "9,01"}])
    assert got == ["REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA"]


def test_greedy_takes_the_best_free_row(spark):
    result = matching.match(side(spark, "rede", {"bruto": "10,00"}, {"bruto": "20,00"}), side(spark, "shift", {"bruto": "20,00"}, {"bruto": "20,00"}))
    pairs = {(r["linha_shift"], r["linha_rede"]) for r in result.detail.select("linha_shift", "linha_rede").collect()}
    assert pairs == {(2, 3), (3, 2)}
    totals = {r["indicador"]: r["valor"] for r in result.summary().collect()}
    assert totals["valor_bruto_total_rede"] == Decimal("30.00") and totals["total_linhas_shift"] == 2


def test_empty_side_is_an_error(spark):
    with pytest.raises(ValueError, match="Rede está vazio"):
        matching.match(side(spark, "rede", {}).limit(0), side(spark, "shift", {}))


def test_csv_export_and_report_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NSU;autorização;valor bruto;Coluna1;Coluna2\n001;55040;1,25;;\n1;2;3;4;5;6\n", encoding="latin-1")
    rows = delimited.read(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["ord", "_line", "NSU", "autorização", "valor bruto"] and [tuple(r) for r in rows.collect()] == [(0, 0, "001", "55040", "1,25")]
    with pytest.raises(ValueError, match="Formato"):
        delimited.read(spark, str(tmp_path / "a.txt"))
    head = "Relatório\n\nEmpresa;Espécie;Forma de pagamento/cobrança;Valor bruto;Nro autorização cartão\n"
    (tmp_path / "r.csv").write_text("﻿" + head + "X;Cartão;REDE 2X VISA;10,00;5040\nX;PIX;PIX ITAU;9,00;1\nEmitido por: Y\n", encoding="utf-8")
    assert delimited.is_report(spark, str(tmp_path / "r.csv")) and not delimited.is_report(spark, str(tmp_path / "a.csv"))
    card, other = delimited.read_report(spark, str(tmp_path / "r.csv"))
    one = schema.normalized_report(card).first()
    assert (one["autorizacao"], one["numero_parcelas"], one["_row"]) == ("005040", 2, 4)
    assert [r["motivo_descarte"] for r in other.collect()] == ["FORMA_PAGAMENTO_NAO_CARTAO"]
    export.write_csv(other, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "out")).count() == 1


def test_formulas_are_made_safe(spark):
    assert spark.range(1).select(export.spreadsheet_safe(F.lit("=1+1")).alias("x")).first()["x"] == "'=1+1"

"""The ledger's financial report: what its lines become, which columns may be missing, and its match."""

from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.operators import schema
from ledgerloom.plans import matching
from ledgerloom.sources import delimited
from ledgerloom.sources.headers import CANONICAL

LINE = {
    "Empresa": "LAB", "Descrição": "OS: 135-67444-235", "Número do documento": "023455", "Vencimento": "27/12/2025", "Data de emissão": "26/11/2025", "Valor líquido": "352,38", "Desconto": "9,82",
    "Tipo de documento": "NOTA FISCAL", "Espécie": "Cartão de Crédito/Débito", "Forma de pagamento/cobrança": "REDE 10X MASTER", "Número da parcela": "8", "Quantidade de parcelas": "10",
    "Código do registro": "022-67324-620", "Valor bruto": "362,20", "Nro autorização cartão": "972902",
}
PIX = {"Espécie": "Transferência", "Forma de pagamento/cobrança": "PIX BANCO", "Número da parcela": "", "Quantidade de parcelas": "", "Nro autorização cartão": ""}
LEAST = ("Empresa", "Espécie", "Forma de pagamento/cobrança", "Valor bruto", "Nro autorização cartão")


def report(folder, *lines, columns=tuple(LINE)):
    """A file with a head of eight lines, a line for each of lines (what differs from LINE), and a foot."""
    body = [";".join((LINE | line).get(c, "") for c in columns) for line in lines]
    head = ["Laboratório", "Rua Um, 556", "Relatório financeiro", "", "DATA PARA PESQUISA;Vencimento", "DATA INICIAL;26/12/2025", "DATA FINAL;29/12/2025", ""]
    path = folder / "report.csv"
    path.write_text("\n".join([*head, ";".join(columns), *body, "", "Emitido por: (1) FULANA - 30/12/2025 às 11:07:27", ""]), encoding="utf-8-sig")
    return str(path)


def rows(spark, path):
    return schema.normalized_report(delimited.read_report(spark, path)[0]).orderBy("ord").collect()


def test_head_and_foot_are_no_rows_and_other_payments_are_counted(spark, tmp_path):
    path = report(tmp_path, {}, PIX)
    assert delimited.is_report(spark, path)
    card, other = delimited.read_report(spark, path)
    assert [r["Empresa"] for r in card.collect()] == ["LAB"] and [r["motivo_descarte"] for r in other.collect()] == ["FORMA_PAGAMENTO_NAO_CARTAO"]
    everything, none = delimited.read_report(spark, path, scope="all")
    assert everything.count() == 2 and none.isEmpty()


@pytest.mark.parametrize(
    ("columns", "message"),
    [
        (("Empresa", "Valor bruto", "Nro autorização cartão"), "Espécie"),
        (("Empresa", "Espécie", "Forma de pagamento/cobrança", "Nro autorização cartão"), '"Valor bruto"'),
        (("Empresa", "Espécie", "Forma de pagamento/cobrança", "Valor bruto"), "Nro autorização cartão"),
    ],
)
def test_missing_columns_are_named(spark, tmp_path, columns, message):
    with pytest.raises(ValueError, match=message):
        delimited.read_report(spark, report(tmp_path, {}, columns=columns))


def test_fields_of_a_line(spark, tmp_path):
    lines = [
        {},
        {"Nro autorização cartão": "5040", "Valor bruto": "362.20"},
        {"Nro autorização cartão": "4Y9HDN", "Forma de pagamento/cobrança": "REDE DEBITO VISA", "Número da parcela": "", "Quantidade de parcelas": ""},
        {"Número da parcela": "1", "Quantidade de parcelas": "3"},
        {"Forma de pagamento/cobrança": "CARTÃO", "Número da parcela": "11", "Quantidade de parcelas": "12", "Nro autorização cartão": ""},
        {"Forma de pagamento/cobrança": "", "Número da parcela": "", "Quantidade de parcelas": "", "Valor bruto": "abc"},
        {"Descrição": "", "Código do registro": "OS: 1-2-3", "Valor bruto": ""},
    ]
    a, b, c, d, e, f, g = rows(spark, report(tmp_path, *lines))
    assert (a["autorizacao"], a["valor_bruto"], a["valor_liquido"], a["valor_desconto"]) == ("972902", Decimal("362.20"), Decimal("352.38"), Decimal("9.82"))
    assert (a["parcela"], a["numero_parcelas"], a["bandeira"], a["modalidade"], a["_alertas_normalizacao"]) == (8, 10, "MASTERCARD", "CREDITO", [])
    assert (a["os_shift"], a["documento_shift"], a["possivel_nsu"], a["status"], a["lote"], a["nsu"]) == ("135-67444-235", "023455", "023455", None, None, None)
    assert (a["data_venda"], a["data_vencimento"], a["_comparar_data_vencimento"], a["campo_data_shift_usado"]) == (date(2025, 11, 26), date(2025, 12, 27), False, "Data de emissão")
    assert [r["_row"] for r in (a, b, g)] == [10, 11, 16]  # lines of the file
    assert (b["autorizacao"], b["valor_bruto"]) == ("005040", Decimal("362.20"))
    assert (c["autorizacao"], c["modalidade"], c["bandeira"], c["parcela"], c["numero_parcelas"]) == ("4Y9HDN", "DEBITO", "VISA", 1, 1)
    assert d["_alertas_normalizacao"] == ["DIVERGENCIA_PARCELAMENTO_FORMA_PAGAMENTO"]
    assert (e["parcela"], e["numero_parcelas"], e["autorizacao"], e["_alertas_normalizacao"]) == (11, 12, None, ["AUTORIZACAO_VAZIA"])
    assert (f["valor_bruto"], f["_alertas_normalizacao"]) == (None, ["VALOR_BRUTO_INVALIDO", "PARCELAMENTO_NAO_IDENTIFICADO"])
    assert g["os_shift"] == "1-2-3" and "VALOR_VAZIO" in g["_alertas_normalizacao"]


def test_few_columns_are_enough(spark, tmp_path):
    least = rows(spark, report(tmp_path, {"Forma de pagamento/cobrança": "REDE 1X VISA"}, columns=LEAST))[0]
    assert (least["valor_liquido"], least["documento_shift"], least["possivel_nsu"], least["data_venda"]) == (None, None, None, None)
    no_form = rows(spark, report(tmp_path, {}, columns=("Empresa", "Espécie", "Valor bruto", "Nro autorização cartão")))[0]
    assert "FORMA_PAGAMENTO_AUSENTE" in no_form["_alertas_normalizacao"] and (no_form["bandeira"], no_form["modalidade"]) == (None, None)
    assert rows(spark, report(tmp_path, {}, columns=("Empresa", "Forma de pagamento/cobrança", "Valor bruto", "Nro autorização cartão")))[0]["bandeira"] == "MASTERCARD"
    assert rows(spark, report(tmp_path, {"Nova": "x"}, columns=(*LINE, "Nova")))[0]["autorizacao"] == "972902"


def test_match_of_a_report_without_nsu_and_with_other_due_dates(spark, tmp_path):
    """The report has no NSU and no establishment, and its due dates are no divergence."""
    ledger = schema.normalized_report(delimited.read_report(spark, report(tmp_path, {}))[0])
    row = ("972902", "555", "362,20", "8", "10", "Master", "Crédito", "paga", "10", "26/11/2025", "29/12/2025")
    fields = ("autorizacao", "nsu", "valor_bruto_original", "parcela", "numero_parcelas", "bandeira", "modalidade", "status", "estabelecimento", "data_venda", "data_vencimento")
    given = spark.createDataFrame([(0, 0, *row)], f"ord bigint, _line bigint, {', '.join(f'{f} string' for f in fields)}")
    acquirer = schema.normalized(given, "rede", {f: f for f in fields}, tuple(CANONICAL))
    one = matching.match(acquirer, ledger).detail.collect()
    assert [r["status_comparacao"] for r in one] == ["CONCILIADO"] and one[0]["shift_data_vencimento_normalizado"] == date(2025, 12, 27)

"""Files in and out, the full run, and the store."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import ConflictError, NotFoundError
from ledgerloom.operators import assign, keeping
from ledgerloom.plans.reconcile import process, reconcile
from ledgerloom.sources import delimited, export, uploads, workbook
from ledgerloom.sources.store import Store
from ledgerloom.sources.uploads import Upload

HEAD = "data do recebimento;data original da venda;valor bruto da parcela original;valor liquido da parcela;nsu;numero da autorizacao;modalidade;bandeira;numero de parcelas;parcela;status;estabelecimento\n"
ROW = "01/12/2025;26/11/2025;{v};{v};{n};{a};Crédito;Visa;1;1;paga;10\n"
REPORT = "Relatório\n\nEmpresa;Espécie;Forma de pagamento/cobrança;Valor bruto;Valor líquido;Nro autorização cartão;Data de emissão;Número da parcela;Quantidade de parcelas;Código do registro\n"


def test_csv_records_may_hold_line_ends(spark, tmp_path):
    """Quoted line ends and separators stay in their cells; a Latin-1 0x85 ends no line."""
    (tmp_path / "a.csv").write_bytes('"x;y";b\n"one\ntwo";1\n"p;q";2\nz\x85w;3\n'.encode("latin-1"))
    rows = delimited.read(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "one\ntwo", "1"), (1, 1, "p;q", "2"), (2, 2, "z\x85w", "3")] and rows[0].__fields__[2:] == ["x;y", "b"]
    (tmp_path / "b.csv").write_text(" \n")
    assert delimited.read(spark, str(tmp_path / "b.csv")).count() == 0 and delimited.read_report(spark, str(tmp_path / "b.csv"))[0].count() == 0


def test_workbooks(spark, tmp_path):
    """Written workbooks read back: the usual sheet is chosen, or the one that looks like a table; headers are found below a title."""
    data = spark.createDataFrame([(None, None, None), ("nsu", "autorizacao", "valor bruto"), ("1", "055040", "=1+1"), ("2", "<&>", None)], "titulo string, b string, c string")
    other = spark.createDataFrame([("x",)], "y string")
    path = str(tmp_path / "a.xlsx")
    export.write_workbook({"Capa": other, "Dados": data}, path)
    assert workbook.list_sheets(spark, path) == ["Capa", "Dados"]
    rows, sheet = workbook.read(spark, path)
    assert sheet == "Dados" and rows.columns[2:] == ["nsu", "autorizacao", "valor bruto"]
    assert [tuple(r)[2:] for r in rows.orderBy("ord").collect()] == [("1", "055040", "'=1+1"), ("2", "<&>", None)]
    with pytest.raises(ValueError, match="não encontrada"):
        workbook.read(spark, path, "Nada")
    export.write_workbook({"Capa": data, "Pagamentos": other}, path)
    assert workbook.read(spark, path)[1] == "Pagamentos"
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="Não foi possível abrir"):
        workbook.read(spark, str(tmp_path / "bad.xlsx"))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("uploads")
    (folder / "rede 01.12.2025.csv").write_text(HEAD + ROW.format(v="10,00", n="1", a="055040") + ROW.format(v="20,00", n="2", a="055041") + ROW.format(v="0,00", n="3", a="055042"), encoding="utf-8")
    (folder / "rede2.csv").write_text(HEAD + ROW.format(v="20,00", n="2", a="055041") + ROW.format(v="30,00", n="4", a="055043"), encoding="utf-8")
    lines = ["A;Cartão;REDE 1X VISA;10,00;10,00;55040;26/11/2025;1;1;R1", "A;Cartão;REDE 1X VISA;20,01;20,00;55041;26/11/2025;1;1;R2", "B;Cartão;REDE 1X VISA;5,00;5,00;1;26/11/2025;1;1;R3", "A;PIX;PIX ITAU;9,00;9,00;2;26/11/2025;1;1;R4"]
    (folder / "shift.csv").write_text(REPORT + "\n".join(lines) + "\nEmitido por: X\n", encoding="utf-8")
    rede = [Upload(str(folder / n), f"REDE_0{k}", n) for k, n in enumerate(("rede 01.12.2025.csv", "rede2.csv"), 1)]
    return rede, [Upload(str(folder / "shift.csv"), "SHIFT_01", "shift.csv")]


def test_reconcile_and_store(spark, files, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    unit = store.create_unit("U1", "Filial A", "10", "A")
    result = process(spark, store, unit, "run-1", *files, "2025-12-01", str(tmp_path / "out"))
    assert sorted(r["status_conciliacao"] for r in result.detail.collect()) == ["CONCILIADO", "CONCILIADO_COM_DIVERGENCIA_TOLERADA", "NAO_ENCONTRADO_NO_SHIFT"]
    run = store.run("run-1")
    expected = {
        "rede_total_linhas_lidas": 5, "rede_linhas_validas_para_conciliacao": 3, "rede_linhas_descartadas": 2, "rede_duplicidades_entre_arquivos": 1, "shift_total_linhas_lidas": 4, "shift_linhas_cartao": 3,
        "shift_linhas_ignoradas_pix_outros": 1, "shift_linhas_antes_filtro_empresa": 3, "shift_linhas_apos_filtro_empresa": 2, "shift_linhas_validas_para_conciliacao": 2, "shift_linhas_descartadas": 2,
        "shift_transacoes_enviadas_para_matching": 2, "quantidade_arquivos_rede_importados": 2, "quantidade_arquivos_shift_importados": 1, "unidade": "Filial A", "valor_bruto_total_rede": 60.0,
        "linhas_lidas_por_arquivo_rede": {"rede 01.12.2025.csv": 3, "rede2.csv": 2}, "linhas_descartadas_por_arquivo_rede": {"rede 01.12.2025.csv": 1, "rede2.csv": 0},
        "shift_motivos_descarte": {"FORMA_PAGAMENTO_NAO_CARTAO": 1, "EMPRESA_FORA_DO_RECORTE": 1}, "motivos_descarte_por_arquivo_rede": {"rede 01.12.2025.csv": {"LINHA_ZERADA": 1}, "rede2.csv": {"DUPLICIDADE_ENTRE_ARQUIVOS_REDE": 1}},
    }
    assert {k: run["resumo"].get(k) for k in expected} == expected
    assert run["arquivos"]["REDE_01"]["quantidade_linhas"] == 3 and run["unidade_nome"] == "Filial A"
    out = json.loads((tmp_path / "out" / "resultado.json").read_text(encoding="utf-8"))
    assert [len(out[k]) for k in ("detalhado", "descartes")] == [3, 4] and len(out["detalhado"][0]) == 133
    assert (tmp_path / "out" / "relatorio_detalhado.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert zipfile.ZipFile(tmp_path / "out" / "relatorio_detalhado.xlsx").testzip() is None
    assert workbook.list_sheets(spark, str(tmp_path / "out" / "relatorio_detalhado.xlsx")) == ["Detalhado", "Auditoria", "Descartes"]
    # the same by executors, of any size
    read = lambda name: [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "resultado" / name)).collect()]
    assert read("detalhado") == out["detalhado"] and sorted(map(str, read("descartes"))) == sorted(map(str, out["descartes"])) and read("qualidade_shift") == out["qualidade_shift"]
    summary = read("resumo")[0]
    assert {k: summary.get(k) for k in expected} == expected
    # the store
    with pytest.raises(ConflictError, match="código"):
        store.create_unit("u1", "Outra")
    with pytest.raises(ConflictError, match="conciliações"):
        store.delete_unit(unit)
    store.update_unit(unit, "U1", "filial b", None, False)
    other = store.create_unit("U2", "Alfa")
    assert [r["nome"] for r in store.units().collect()] == ["Alfa", "filial b"] and [r["id"] for r in store.units(active_only=True).collect()] == [other]
    assert [r["id"] for r in store.runs(unit, "2025-12-01", "2025-12-31").collect()] == ["run-1"] and store.runs(start="2026-01-01").isEmpty()
    assert len(store.delete_run("run-1")) == 3 and store.run("run-1") is None
    with pytest.raises(NotFoundError):
        store.delete_run("run-1")
    store.delete_unit(unit)
    assert store.unit(unit) is None


def test_wrong_day_or_company(spark, files):
    with pytest.raises(ValueError, match="data selecionada"):
        reconcile(spark, *files, "2025-12-02")
    with pytest.raises(ValueError, match="empresa cadastrada"):
        reconcile(spark, *files, "2025-12-01", company="C")


def test_lineage_of_several_files(spark, files):
    rows = uploads.acquirer(spark, files[0]).orderBy("ord").collect()
    assert [(r["rede_origem_id"], r["_row"], str(r["rede_data_relatorio"])) for r in rows] == [("REDE_01", 2, "2025-12-01"), ("REDE_01", 3, "2025-12-01"), ("REDE_01", 4, "2025-12-01"), ("REDE_02", 2, "None"), ("REDE_02", 3, "None")]


def test_a_hot_authorisation_is_assigned_in_one_pass(spark):
    """20,000 rows of one authorisation on either side; and against a plain loop on a small mixed key."""
    side = lambda n, value: spark.range(n).select(F.col("id").alias("ord"), F.lit("7").alias("autorizacao"), value.cast("decimal(28,2)").alias("valor_bruto"), F.lit(1).alias("parcela"), F.lit(1).alias("numero_parcelas"), F.concat(F.lit("n"), F.col("id")).alias("nsu"), F.lit("2025-01-01").cast("date").alias("data_venda"), F.lit(False).alias("_grouped"))
    n = 20_000
    hot = assign.assigned(side(n, F.col("id") % 500), side(n, (n - F.col("id")) % 700))
    assert hot.where("outcome = 'taken'").select("r_ord").distinct().count() == n
    s, r = (side(60, F.pmod(F.hash("id", F.lit(k)), F.lit(6)) / 100).withColumn("parcela", F.pmod(F.hash("ord", F.lit(k + 2)), F.lit(3)).cast("int")).withColumn("numero_parcelas", F.lit(2)).withColumn("nsu", F.concat(F.lit("n"), F.pmod(F.hash("ord", F.lit(k + 4)), F.lit(9)))) for k in (1, 2))
    scores = {(x["s_ord"], x["r_ord"]): tuple(x["score"]) for x in assign.candidate_scores(s, r).collect()}
    free, expected = set(range(60)), {}
    for i in range(60):
        best = max(free, key=lambda j: scores[i, j])
        expected[i] = best
        free.remove(best)
    assert {x["s_ord"]: x["r_ord"] for x in assign.assigned(s, r).collect()} == expected


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        keeping.shared_folder(Session())


def test_a_large_day_has_sections_and_no_files(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "DAY_ROWS", 2)
    monkeypatch.setattr(export, "write_reports", None)
    store = Store(spark, str(tmp_path / "store"))
    process(spark, store, store.create_unit("U1", "Filial A", "10", "A"), "run-1", *files, "2025-12-01", str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["detalhado_csv", "qualidade_shift_csv", "resultado"] and store.run("run-1")["resumo"]["rede_total_linhas_lidas"] == 5
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "out" / "detalhado_csv")).count() == 3

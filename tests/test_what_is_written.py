"""What runs and reports write: no more than the rows that are asked for need."""

import os

from pyspark.sql import functions as F
from test_matching import side

from ledgerloom.functions import TEXT
from ledgerloom.functions.codes import IDENTIFIER
from ledgerloom.operators import assign, classify, keeping, prepare, quality, schema
from ledgerloom.plans import matching, queries, sides
from ledgerloom.sources import export


def _kept(spark):
    folder = keeping.shared_folder(spark)
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()



def _result(spark, n=1):
    files = F.lit("a.csv")
    return matching.match(side(spark, "rede", *[{"autorizacao": f"{k:06d}"} for k in range(1, n + 1)]).withColumn("rede_arquivo_origem", files), side(spark, "shift", {"autorizacao": "000001"}))


def test_counts_of_rows_make_no_assignment(spark):  # F1, F4
    before = _kept(spark)
    counts = {r["indicador"]: r["valor"] for r in matching.row_counts(_result(spark, 3)).collect()}
    assert (counts["total_linhas_rede"], counts["total_linhas_shift"]) == (3, 1)
    made = " ".join(_kept(spark) - before)
    assert "consolidated" in made and "outcome" not in made and "kinds" not in made and "rows-" not in made


def test_the_summary_is_written_alone(spark, tmp_path):  # F2
    result = _result(spark)
    result.counters, result.discards = spark.createDataFrame([], "indicador string, valor bigint"), prepare.partitioned(result.acquirer, "REDE")[1]
    written = export.write_sections(result, str(tmp_path), only=("resumo",))
    assert list(written) == ["resumo"] and os.listdir(tmp_path / "resultado") == ["resumo"]
    assert '"total_linhas_rede":1' in spark.read.text(written["resumo"]).first()[0]


def test_sections_are_compressed(spark, tmp_path):  # F3
    result = _result(spark, 400)
    written = export.write_sections(result, str(tmp_path), only=("detalhado",))
    assert list(written) == ["detalhado"] and os.listdir(tmp_path) == ["resultado"]
    on_disk = sum(f.stat().st_size for f in (tmp_path / "resultado" / "detalhado").iterdir() if f.name.startswith("part"))
    lines = spark.read.text(written["detalhado"])
    text = lines.agg(F.sum(F.octet_length("value"))).first()[0]
    assert lines.count() == 400 and on_disk * 8 < text


def test_duplicates_keep_narrow_marks(spark):  # F5
    values = ({"autorizacao": "000001"}, {"autorizacao": "000001"}, {"autorizacao": "000002"}, {"autorizacao": "000001"}, {"autorizacao": "000002"}, {"autorizacao": None}, {"autorizacao": None})
    named = {0: None, 1: "b.csv", 2: "", 3: "a.csv", 4: "a.csv", 5: "a.csv", 6: "b.csv"}
    file = F.coalesce(*(F.when(F.col("ord") == k, F.lit(x)) for k, x in named.items()))
    before = _kept(spark)
    kept, gone = prepare.deduplicated(matching.schema.acquirer(side(spark, "rede", *values).withColumn("rede_arquivo_origem", file)))
    rows = {r["ord"]: (r["rede_duplicado_entre_arquivos"], r["rede_arquivos_duplicados"]) for r in kept.collect()}
    assert rows == {0: (True, "b.csv | a.csv"), 2: (False, None), 4: (False, None), 5: (True, "a.csv | b.csv")}
    assert sorted(r["numero_linha_original"] for r in gone.collect()) == ["3", "5", "8"]
    [marks] = [name for name in _kept(spark) - before if name.startswith("repeated-")]
    assert len(spark.read.parquet(f"{keeping.shared_folder(spark)}/{marks}").columns) == 4


def test_sides_hold_their_match_keys_and_no_raw_table(spark):  # F6 to F25
    keeping.clear(spark)
    folder = "/root/testdata/sf0.001"
    a, l = sides.acquirer(spark, folder), sides.ledger(spark, folder)  # noqa: E741
    assert not any(name.startswith("raw") for name in _kept(spark))
    ordinary = l.withColumn("_grouped", F.lit(False))
    before = _kept(spark)
    found = assign.assigned(ordinary, a)
    made = " ".join(_kept(spark) - before)
    assert "offered" not in made and "choosing" not in made
    assert found.exceptAll(assign.assigned(ordinary.drop("auth_key"), a.drop("auth_key"))).isEmpty()
    again = sides.raw_ledger(spark, folder).select("ord", "autorizacao", "valor_bruto_original", "valor_liquido", "nsu", "parcela", "data_venda")
    assert again.exceptAll(l.select("ord", *(F.col(f"raw_{c}").alias(c) for c in ("autorizacao",)), "raw_valor_bruto", "raw_valor_liquido", "raw_nsu", "raw_parcela", "raw_data_venda")).isEmpty()
    assert again.count() == l.count()


def test_plain_texts_pass_the_look_ups_by(spark):  # F6 to F19
    texts = ["a", " a", "a ", "a b", " a ", "a\n", "\ta b\n", "é ", "", " ", "-", "\x1fa\x1f", "12.0", "12.00 ", "1 2.0", "1.05", "nan", ".0", "a\x00"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    expected = [None if x.strip().upper() in ("", "-", "NAN", "NONE", "NAT") else x.strip() for x in texts]
    assert [r[0] for r in rows.select(TEXT(F.col("x"))).collect()] == expected
    got = [r[0] for r in rows.select(IDENTIFIER(F.col("x"))).collect()]
    assert got[12:17] == ["12", "12", "12", "1.05", None] and got[3] == "AB"
    assert "RLIKE" in rows.select(TEXT(F.col("x")))._jdf.queryExecution().analyzed().toString()


def test_sides_write_no_constants_and_codes_are_narrow(spark):  # F7 to F24
    keeping.clear(spark)
    folder = "/root/testdata/sf0.001"
    wide = {"acquirer": sides.acquirer(spark, folder), "ledger": sides.ledger(spark, folder), "consolidated": queries._consolidated(spark, folder)}
    names = {name.split("-")[0]: name for name in _kept(spark)}
    for side_, rows in wide.items():
        table = spark.read.parquet(f"{keeping.shared_folder(spark)}/{names[side_]}")
        assert not {"taxa_mdr", "raw_lote", "_source", "banco"} & set(table.columns) and {"taxa_mdr", "raw_lote", "_source", "banco"} <= set(rows.columns)
        empty = table.agg(*(F.count(c).alias(c) for c in table.columns)).first().asDict()
        assert {c for c, n in empty.items() if not n} <= {"autorizacao_erro", "rede_arquivos_duplicados"}
    complete = {"acquirer": schema.acquirer, "ledger": schema.ledger}
    for side_, make in complete.items():
        rows = wide[side_]
        assert make(rows).schema.simpleString() == rows.schema.simpleString() and make(rows).exceptAll(rows).isEmpty()
    assert wide["ledger"].where("valor_bruto_original is distinct from valor_bruto or not _comparar_data_vencimento or size(_alertas_normalizacao) > 0 or _source != 'shift' or cancelamento != ''").isEmpty()
    before = _kept(spark)
    coded = quality.with_codes(wide["consolidated"])
    [codes] = _kept(spark) - before
    assert spark.read.parquet(f"{keeping.shared_folder(spark)}/{codes}").columns == ["ord", "codes"] and coded.count() == wide["consolidated"].count()


def test_only_pairs_pay_for_what_pairs_need(spark):  # F7 to F22
    result = matching.match(side(spark, "rede", {"autorizacao": "000001"}, {"autorizacao": "000002"}), side(spark, "shift", {"autorizacao": "000001"}))
    s, r = result.ledger.withColumns({"_case": F.lit(classify.PAIRED), "_partner": F.lit(0)}), result.acquirer
    joined = s.alias("s").join(r.alias("r"), F.col("s._partner") == F.col("r.ord"), "full")
    rows = classify.judged(joined, F.coalesce("s._case", F.lit(classify.LEFT_OVER))).select("_j_case", "_j_found", "_j_field_names", "_j_tolerated", "_j_statuses", "_j_fields").collect()
    own = {x["_j_case"]: x for x in rows}
    assert own[classify.PAIRED]["_j_found"] is not None and own[classify.PAIRED]["_j_statuses"]
    left = own[classify.LEFT_OVER]
    assert (left["_j_found"], left["_j_field_names"], left["_j_tolerated"]) == (None, None, None) and (left["_j_statuses"], left["_j_fields"]) == ([classify.NOT_IN_LEDGER], [])

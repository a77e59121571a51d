"""Before matching: valid and discarded rows, duplicates across files, the company filter, context checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.keeping import keep

#: Columns of the discard report, and where each comes from.
DISCARD = {
    "origem": (), "numero_linha_original": ("_source_line", "_row", "rede_linha_original"), "empresa": ("empresa", "Empresa", "descricao_credor_devedor"),
    "autorizacao_original": ("raw_autorizacao", "Nro autorização cartão"), "autorizacao_normalizada": ("autorizacao",), "valor_bruto": ("valor_bruto", "Valor bruto"),
    "valor_liquido": ("valor_liquido", "Valor líquido"), "data_venda": ("data_venda", "Data de emissão", "data original da venda"),
    "modalidade": ("modalidade", "Forma de pagamento/cobrança"), "bandeira": ("bandeira",), "parcela": ("parcela", "Número da parcela"),
    "qtd_parcelas": ("numero_parcelas", "Quantidade de parcelas"), "arquivo_origem": ("rede_arquivo_origem",), "aba_origem": ("rede_aba_origem",),
    "data_relatorio": ("rede_data_relatorio",), "motivo_descarte": (), "observacao": (),
}
NO_AUTHORIZATION, BAD_VALUE, ZERO_VALUE = "AUTORIZACAO_AUSENTE", "VALOR_INVALIDO", "LINHA_ZERADA"
ZERO_NOTE = "Valor bruto igual a zero; mantida na auditoria."
DUPLICATE, OTHER_COMPANY = "DUPLICIDADE_ENTRE_ARQUIVOS_REDE", "EMPRESA_FORA_DO_RECORTE"
DEDUP_FIELDS = ("autorizacao", "nsu", "valor_bruto", "valor_liquido", "data_venda", "data_recebimento", "parcela", "numero_parcelas", "bandeira", "modalidade")
DEDUP_CRITERION = "AUTORIZACAO+NSU+VALORES+DATAS+PARCELA+BANDEIRA+MODALIDADE"


def discards(rows: DataFrame, origin: str, reason: Column | str, note: Column | str = "") -> DataFrame:
    """The discard report's columns, as text, for rows that are left out."""
    given = {"origem": F.lit(origin), "motivo_descarte": F.lit(reason) if isinstance(reason, str) else reason, "observacao": F.lit(note) if isinstance(note, str) else note}
    own = {c: given.get(c, F.coalesce(F.lit(None).cast("string"), *(F.col(f"`{x}`").cast("string") for x in names if x in rows.columns))) for c, names in DISCARD.items()}
    return rows.select(*(c.alias(name) for name, c in own.items()))


def reason_to_discard() -> Column:
    gone = F.col("autorizacao").isNull() | (F.trim("autorizacao") == "")
    return F.when(gone, NO_AUTHORIZATION).when(F.col("valor_bruto").isNull(), BAD_VALUE).when(F.col("valor_bruto") == 0, ZERO_VALUE)


def partitioned(rows: DataFrame, origin: str) -> tuple[DataFrame, DataFrame]:
    """The rows that can be matched, and the discard report of the others."""
    judged = rows.withColumn("_reason", reason_to_discard())
    note = F.when(F.col("_reason") == ZERO_VALUE, F.lit(ZERO_NOTE)).otherwise(F.lit(""))
    return judged.where("_reason is null").drop("_reason"), discards(judged.where("_reason is not null"), origin, F.col("_reason"), note)


def repeated(acquirer: DataFrame) -> DataFrame:
    """A kept row for each record of a group over several files: ord, _is_first, _in_files (the group's files where it is the first, else its own) and _kept_in.

    Records are compared by two 64-bit hashes of their fields (among 250 M records about one chance in 10^22 of any collision). Only these, the
    file and ord are moved, once: files and first rows are found by windows, so that a hot record's rows are streamed.
    """
    file = F.col("rede_arquivo_origem")
    fields = [x for f in DEDUP_FIELDS for x in (F.col(f), F.col(f).isNull())]  # hashes pass nulls by
    narrow = acquirer.select("ord", file, F.xxhash64(*fields).alias("_a"), F.xxhash64(F.lit("second"), *reversed(fields)).alias("_b")).repartition("_a", "_b")
    group, of_file = Window.partitionBy("_a", "_b"), Window.partitionBy("_a", "_b", "rede_arquivo_origem")
    named = F.when(file != "", file)  # those without a file belong to the group, too: the first row of all is kept
    several = narrow.withColumns({"_least": F.min(named).over(group), "_most": F.max(named).over(group)}).where("_least < _most").withColumn("_first", F.min("ord").over(of_file))
    files = F.array_sort(F.collect_set(F.when(file != "", F.struct("_first", file.alias("file")))).over(group))
    found = several.select("ord", file, files.alias("files"), F.min(F.struct("ord", file.alias("file"))).over(group).alias("keeper"))
    is_first = F.col("keeper.ord") == F.col("ord")
    in_files = F.when(is_first, F.array_join(F.transform("files", lambda x: x["file"]), " | ")).otherwise(file)
    return keep(found.select("ord", is_first.alias("_is_first"), in_files.alias("_in_files"), F.col("keeper.file").alias("_kept_in")), "repeated")


def deduplicated(acquirer: DataFrame, marks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Records that several files hold are kept once, in the first; the rest goes to the discard report. acquirer: read several times.

    Equal records within one file all stay. marks: what repeated() gives, where it is there already; the wide rows meet it by ord.
    """
    marks = repeated(acquirer) if marks is None else marks
    judged = acquirer.join(marks, "ord", "left")
    first = F.coalesce("_is_first", F.lit(False))
    own = {
        "rede_duplicado_entre_arquivos": first,
        "rede_arquivos_duplicados": F.when(first, F.col("_in_files")),
        "criterio_deduplicacao_rede": F.when(first, F.lit(DEDUP_CRITERION)),
    }
    kept = judged.where(F.col("_is_first").isNull() | first).withColumns(own).select(acquirer.columns)
    note = F.concat(F.lit("Registro duplicado em múltiplos arquivos da Rede. Mantido: "), "_kept_in", F.lit("."))
    return kept, discards(acquirer.join(marks.where("not _is_first"), "ord"), "REDE", DUPLICATE, note)


def counted(rows: DataFrame, origin: str) -> DataFrame:
    """origem, arquivo_origem, motivo_descarte (null for the rows that can be matched) and quantidade: what partitioned() makes of the rows, without them."""
    file = F.col("rede_arquivo_origem") if "rede_arquivo_origem" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy(file.alias("arquivo_origem"), reason_to_discard().alias("motivo_descarte")).agg(F.count("*").alias("quantidade")).select(F.lit(origin).alias("origem"), "arquivo_origem", "motivo_descarte", "quantidade")


def counted_repeated(marks: DataFrame) -> DataFrame:
    """The same of the discarded records of repeated()."""
    of_files = marks.where("not _is_first").groupBy(F.col("_in_files").alias("arquivo_origem")).agg(F.count("*").alias("quantidade"))
    return of_files.select(F.lit("REDE").alias("origem"), "arquivo_origem", F.lit(DUPLICATE).alias("motivo_descarte"), "quantidade")


#: Distinct values that a message or a run's context shows at most; context_values has all of them as rows.
SHOWN = 1000


def _texts(rows: DataFrame, *columns: Column) -> list[list[str]]:
    """The distinct non-empty texts of each column, sorted, the first SHOWN of them."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.nullif(c, F.lit("")).alias("text")) for k, c in enumerate(columns)))
    found = rows.select(F.inline(pairs)).where("text is not null").distinct()
    places = found.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("text"))).where(F.col("place") <= SHOWN)
    out: list[list[str]] = [[] for _ in columns]
    for r in places.orderBy("k", "place").collect():
        out[r["k"]].append(r["text"])
    return out


def of_company(ledger: DataFrame, company: str | None) -> tuple[DataFrame, DataFrame]:
    """The rows of one company and the discard report of the others; all rows where none is expected. No such row at all is an error."""
    nothing = discards(ledger.limit(0), "SHIFT", OTHER_COMPANY)
    if not company or "empresa" not in ledger.columns:
        return ledger, nothing
    expected = company.strip()
    own = F.coalesce(F.upper(F.trim("empresa")) == expected.upper(), F.lit(False))
    if ledger.where(own).isEmpty():
        found = ", ".join(_texts(ledger, F.trim("empresa"))[0]) or "nenhuma"
        raise ValueError(f'A empresa cadastrada para a unidade ("{expected}") não foi encontrada na coluna "Empresa" do Shift. Empresas disponíveis: {found}.')  # fixed value: the message
    return ledger.where(own), discards(ledger.where(~own), "SHIFT", OTHER_COMPANY, f'Empresa diferente da unidade selecionada ("{expected}").')


def companies(ledger: DataFrame) -> DataFrame:
    """empresas: one row with the sorted distinct companies, found by partial aggregation."""
    return ledger.select(F.trim("empresa").alias("x")).where("x != ''").distinct().agg(F.sort_array(F.collect_list("x")).alias("empresas"))


def company_alert(expected: Column, found: Column) -> Column:
    """The alert that none of the companies found is the expected one, or null."""
    absent = (F.size(found) > 0) & ~F.exists(found, lambda x: F.upper(x) == F.upper(F.trim(expected)))
    text = F.concat(F.lit('A empresa cadastrada para esta unidade ("'), F.trim(expected), F.lit('") não aparece na coluna "Empresa" do relatório do Shift. Empresa(s) encontrada(s): '), F.array_join(found, ", "), F.lit("."))  # fixed values
    return F.when(absent, text)


def company_alerts(ledger: DataFrame, company: str | None) -> list[str]:
    if not company or "empresa" not in ledger.columns:
        return []
    alert = companies(ledger).select(company_alert(F.lit(company), F.col("empresas"))).first()[0]
    return [alert] if alert else []


def acquirer_context(acquirer: DataFrame, day: str, establishment: str | None = None) -> dict[str, list[str]]:
    """The days, establishments and names that the report holds, the first SHOWN of each; an error if it isn't of the expected day and establishment."""
    own_day, own_place = F.col("data_recebimento").cast("string"), F.nullif(F.upper(F.trim("estabelecimento")), F.lit(""))
    expected = (establishment or "").strip().upper()
    holds = lambda c, value: F.bool_or(c == value)  # noqa: E731  null where no row has a value
    has = acquirer.agg(holds(own_day, day).alias("day"), holds(own_place, expected).alias("place")).first()
    days, places, names = _texts(acquirer, own_day, own_place, F.trim("nome_estabelecimento"))
    if has["day"] is False:
        raise ValueError(f"A data selecionada ({day}) não corresponde ao arquivo da Rede. Data encontrada: {', '.join(days)}.")  # fixed value: the message
    if expected and has["place"] is False:
        raise ValueError(f"O estabelecimento da unidade selecionada ({expected}) não corresponde ao arquivo da Rede. Estabelecimento encontrado: {', '.join(places)}.")  # fixed value: the message
    return {"datas_recebimento": days, "estabelecimentos": places, "nomes_estabelecimento": names}


def context_values(acquirer: DataFrame) -> DataFrame:
    """campo and valor: the distinct days, establishments and names of the report, as rows."""
    fields = {"data_recebimento": F.col("data_recebimento").cast("string"), "estabelecimento": F.upper(F.trim("estabelecimento")), "nome_estabelecimento": F.trim("nome_estabelecimento")}
    pairs = F.array(*(F.struct(F.lit(name).alias("campo"), F.nullif(c, F.lit("")).alias("valor")) for name, c in fields.items()))
    return acquirer.select(F.inline(pairs)).where("valor is not null").distinct()


def card_scope(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The card rows of the ledger's financial report, by their kind or payment form, and the others."""
    text = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in report.columns else F.lit("")
    card = F.lower(text("Espécie")).contains("cart") | F.upper(F.trim(text("Forma de pagamento/cobrança"))).startswith("REDE")
    return report.where(card), report.where(~card)


def all_discards(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)

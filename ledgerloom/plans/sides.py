"""Two synthetic sides made of the TPC-H-like test tables, by SQL that Spark and other engines run alike.

Side A has a row for each lineitem, side L one or two for each order, off by a rule of the order's number: missing, cents or
more off, another authorisation, date or instalment, split over two service orders, repeated, conflicting, blank, zero, or of
another company. {div} is the integer division of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import assign, schema
from ledgerloom.operators.keeping import is_made, keep_but, once
from ledgerloom.sources.headers import CANONICAL

_CENTS = "CAST(cents {div} 100 AS STRING) || ',' || lpad(CAST(cents % 100 AS STRING), 2, '0')"

ACQUIRER_SQL = """
    SELECT l_orderkey * 100 + piece AS ord, l_orderkey * 100 + piece AS _line, l_orderkey AS order_key, piece, pieces,
           CASE l_orderkey % 7 WHEN 0 THEN '0' || code WHEN 1 THEN code || '.0' WHEN 2 THEN ' ' || code ELSE code END AS autorizacao,
           '00' || CAST(l_partkey AS STRING) AS nsu, {gross} AS valor_bruto_original, {net} AS valor_liquido,
           CAST(piece AS STRING) || '/' || CAST(pieces AS STRING) AS parcela, CAST(o_day AS STRING) AS data_venda, CAST(s_day AS STRING) AS data_recebimento,
           CASE l_orderkey % 5 WHEN 0 THEN 'Visa' WHEN 1 THEN 'MasterCard' WHEN 2 THEN 'Elo Débito' WHEN 3 THEN 'Amex' ELSE 'Hipercard' END AS bandeira,
           CASE l_orderkey % 3 WHEN 0 THEN 'Crédito à vista' WHEN 1 THEN 'débito' ELSE 'PIX' END AS modalidade,
           CASE WHEN l_orderkey % 97 = 0 THEN 'Cancelada' ELSE 'paga' END AS status, CASE WHEN l_orderkey % 97 = 0 THEN 'sim' ELSE '' END AS cancelamento,
           CASE WHEN l_orderkey % 50 = 3 THEN 'b.csv' ELSE 'a.csv' END AS rede_arquivo_origem, cents, net_cents, code
    FROM (
        SELECT *, cents - (cents * pct) {div} 100 AS net_cents FROM (
            SELECT l_orderkey, l_partkey, CAST(l_orderkey % 1000000 AS STRING) AS code, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS pct,
                   CAST(o_orderdate AS DATE) AS o_day, CAST(l_shipdate AS DATE) AS s_day,
                   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS BIGINT) AS piece,
                   CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS pieces
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        ) x
    ) y
"""

LEDGER_SQL = """
    SELECT order_key * 10 + part AS ord, order_key * 10 + part AS _line, k,
           CASE k WHEN 3 THEN 'Z' || code WHEN 9 THEN '-' ELSE autorizacao END AS autorizacao, nsu,
           CAST(own {div} 100 AS STRING) || ',' || lpad(CAST(own % 100 AS STRING), 2, '0') AS valor_bruto_original,
           CAST(own_net {div} 100 AS STRING) || ',' || lpad(CAST(own_net % 100 AS STRING), 2, '0') AS valor_liquido,
           CASE k WHEN 5 THEN CAST(piece + 1 AS STRING) || ' de ' || CAST(pieces + 1 AS STRING) WHEN 13 THEN '' ELSE parcela END AS parcela,
           CASE k WHEN 4 THEN data_recebimento ELSE data_venda END AS data_venda,
           CASE WHEN k = 8 AND part = 1 THEN 'Sorocred' ELSE bandeira END AS bandeira, CASE k WHEN 12 THEN 'Voucher' ELSE modalidade END AS modalidade,
           'PAGA' AS status, CASE k WHEN 11 THEN 'FILIAL B' ELSE 'FILIAL A' END AS empresa,
           CASE WHEN k = 6 THEN 'OS-' || CAST(order_key AS STRING) || '-' || CAST(part AS STRING) ELSE 'OS-' || CAST(order_key AS STRING) END AS os_shift, 'REG' || CAST(order_key AS STRING) AS codigo_registro
    FROM (
        SELECT a.*, p.part, order_key % 20 AS k,
               CASE order_key % 20 WHEN 1 THEN cents + 2 WHEN 2 THEN cents + 500 WHEN 6 THEN (CASE p.part WHEN 0 THEN cents {div} 2 ELSE cents - cents {div} 2 END) WHEN 10 THEN 0 ELSE cents END AS own,
               CASE order_key % 20 WHEN 6 THEN (CASE p.part WHEN 0 THEN net_cents {div} 2 ELSE net_cents - net_cents {div} 2 END) ELSE net_cents END AS own_net
        FROM acquirer_rows a JOIN (SELECT 0 AS part UNION ALL SELECT 1 AS part) p ON p.part = 0 OR order_key % 20 IN (6, 7, 8)
        WHERE a.piece = 1 AND order_key % 20 <> 0
    ) z
"""


def sql(div: str) -> tuple[str, str]:
    """The two queries for an engine; the ledger's reads the acquirer's as acquirer_rows."""
    gross, net = _CENTS.replace("{div}", div), _CENTS.replace("{div}", div).replace("cents", "net_cents")
    return ACQUIRER_SQL.replace("{gross}", gross).replace("{net}", net).replace("{div}", div), LEDGER_SQL.replace("{div}", div)


def _inputs(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders")]


def _raw_acquirer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = dict(zip(("lineitem", "orders"), (spark.read.parquet(path) for path in _inputs(sf_dir)), strict=True))
    return spark.sql(sql("div")[0].replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}"), **tables)


def raw_acquirer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side A as its files would have it."""
    return _raw_acquirer(spark, sf_dir)


def _of(rows: DataFrame, spark: SparkSession) -> DataFrame:
    return spark.sql(sql("div")[1].replace("FROM acquirer_rows", "FROM {acquirer_rows}"), acquirer_rows=rows)


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(raw_acquirer(spark, sf_dir), spark)


#: What the ledger's rows are made of beside the texts: numbers of an order's first row.
_NUMBERS = ("order_key", "piece", "pieces", "cents", "net_cents", "code")
_TEXTS = ("autorizacao", "nsu", "parcela", "data_venda", "data_recebimento", "bandeira", "modalidade")


#: Columns that repeat another one, as no side has updated values.
_COPIES = {"valor_bruto_original": "valor_bruto", "raw_valor_bruto": "raw_valor_bruto_original"}


def _copies(**more: str) -> dict[str, Column]:
    """The copies, and _row: the line is ord on both sides, and _row is two more (schema.normalized)."""
    return {c: F.col(of) for c, of in (_COPIES | more).items()} | {"_row": F.col("ord") + 2}


def acquirer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side A in canonical form, with all its columns, its match keys and, for side L, the numbers of each order's first row."""

    def make() -> DataFrame:
        raw = _raw_acquirer(spark, sf_dir).withColumn("_first", F.when(F.col("piece") == 1, F.struct(*_NUMBERS)))
        own = schema.normalized(raw, schema.ACQUIRER, {c: c for c in CANONICAL}, tuple(CANONICAL), ("rede_arquivo_origem", "_first"))
        constants = schema.constants(schema.ACQUIRER, tuple(CANONICAL), set(raw.columns), own.columns)
        return keep_but(assign.with_key(schema.acquirer(own)), "acquirer", constants | _copies())

    return once(spark, "acquirer", _inputs(sf_dir), make)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side L in canonical form, with all its columns and its match keys.

    It is made of the kept side A where there is one, so that the test tables are read and joined once; a query that reads side L alone
    pays for no side A, and takes the orders' first rows as they are.
    """
    return _ledger(spark, sf_dir)[0]


def constants_of_ledger(spark: SparkSession, sf_dir: str) -> dict[str, Column]:
    """Columns that hold the same in all rows of side L."""
    return _ledger(spark, sf_dir)[1]


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    def make() -> tuple[DataFrame, dict[str, Column]]:
        if is_made(spark, "acquirer", _inputs(sf_dir)):
            first = acquirer(spark, sf_dir).where("_first is not null").select("_first.*", *(F.col(f"raw_{c}").alias(c) for c in _TEXTS))
        else:
            first = _raw_acquirer(spark, sf_dir).where("piece = 1").select(*_NUMBERS, *_TEXTS)
        raw = _of(first, spark)
        own = schema.normalized(raw, schema.LEDGER, {c: c for c in CANONICAL}, tuple(CANONICAL), ("empresa", "os_shift", "codigo_registro")).withColumn("data_shift_usada_para_match", F.col("data_venda"))
        constants = schema.constants(schema.LEDGER, tuple(CANONICAL), set(raw.columns), own.columns)
        return keep_but(assign.with_key(schema.ledger(own)), "ledger", constants | _copies(data_shift_usada_para_match="data_venda")), constants

    return once(spark, "ledger", _inputs(sf_dir), make)

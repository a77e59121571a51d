"""The second stage: ledger rows without a usable authorisation meet free acquirer rows by a composite key, for review only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import criterion
from ledgerloom.functions.installments import EXACT, SAME_REMAINING
from ledgerloom.operators.assign import CENTS, tolerance
from ledgerloom.operators.keeping import keep, keep_counted

KEY = ("valor_bruto", "data_venda", "modalidade", "bandeira")
#: So many waiting rows at most are sent to all tasks, where free rows of other keys then leave before they are moved.
FEW = 1 << 17
#: Fixed values.
REVIEW, AMBIGUOUS, NOTHING = "REVISAR_AUTORIZACAO_DIVERGENTE_ALTA_CONFIANCA", "AMBIGUO_SEM_AUTORIZACAO_COMPATIVEL", "SEM_AUTORIZACAO_COMPATIVEL"


def normal_sale() -> Column:
    """A row with a value and no sign of cancellation, contest, unscheduling or reversal."""
    text = F.upper(F.concat_ws(" ", "status", "cancelamento"))
    return F.col("valor_bruto").isNotNull() & (F.col("valor_bruto") != 0) & ~text.rlike("CANCEL|CONTEST|DESAGEND|ESTORN")


def candidates(pending: DataFrame, pool: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Pairs (s_ord, r_ord): equal keys without nulls, net values within tolerance, compatible instalments, a normal sale. For inspection; classified() makes none. taken: see _asked."""
    own = ("ord", "valor_liquido", "parcela", "numero_parcelas")
    s, n = keep_counted(pending.dropna(subset=[*KEY, "valor_liquido"]).select(*KEY, *(F.col(c).alias(f"s_{c}") for c in own)), "waiting")
    r = _asked(pool.where(normal_sale()).dropna(subset=[*KEY, "valor_liquido"]), s, n["n"], taken).select(*KEY, *(F.col(c).alias(f"r_{c}") for c in own))
    near = F.abs(F.col("r_valor_liquido") - F.col("s_valor_liquido")) <= tolerance()
    compatible = criterion(F.col("s_parcela"), F.col("s_numero_parcelas"), F.col("r_parcela"), F.col("r_numero_parcelas")).isin(EXACT, SAME_REMAINING)
    return s.join(r, list(KEY)).where(near & compatible).select("s_ord", "r_ord")


def _asked(pool: DataFrame, waiting: DataFrame, n: int, taken: DataFrame | None) -> DataFrame:
    """The rows of pool whose key a waiting row has; all of it where many rows wait. A join on the key follows. taken: ord of rows that aren't free; they leave last, when few rows are left to be moved."""
    asked = pool.join(F.broadcast(waiting.select(*KEY).distinct()), list(KEY), "left_semi") if n <= FEW else pool
    return asked if taken is None else asked.join(taken, "ord", "left_anti")


def classified(pending: DataFrame, pool: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """s_ord, r_ord and kind of each ledger row with candidates: REVIEW with its row if both have only each other, else AMBIGUOUS.

    No pairs are made of rows: rows that agree in all that is compared are one class with their number, counted with map-side
    aggregation, and classes meet on the key and the net value's cents, so a hot key gives as many pairs as it has
    different values. A pair of rows is unique if either class finds one row only.
    """
    net = (F.col("valor_liquido") * 100).cast("decimal(38,0)")
    same = [*KEY, "cents", "parcela", "numero_parcelas"]
    sale = lambda df: df.dropna(subset=[*KEY, "valor_liquido"]).withColumn("cents", net).select("ord", *same)
    s, n = keep_counted(sale(pending), "waiting")
    r = sale(_asked(pool.where(normal_sale()), s, n["n"], taken))
    classes = lambda df, x: df.groupBy(*same).agg(F.count("*").alias(f"n_{x}"), F.min("ord").alias(f"{x}_ord")).withColumnsRenamed({c: f"{x}_{c}" for c in same if c not in KEY})
    near = F.explode(F.array(*((F.col("s_cents") + d).cast("decimal(38,0)") for d in range(-CENTS, CENTS + 1))))
    met = classes(s, "s").withColumn("r_cents", near).join(classes(r, "r"), [*KEY, "r_cents"])
    compatible = criterion(F.col("s_parcela"), F.col("s_numero_parcelas"), F.col("r_parcela"), F.col("r_numero_parcelas")).isin(EXACT, SAME_REMAINING)
    met = keep(met.where(compatible).select("s_ord", "r_ord", "n_s", "n_r"), "classes")  # the least row stands for its class
    per_s = met.groupBy("s_ord").agg(F.sum("n_r").alias("found"), F.min("r_ord").alias("r_ord"))
    per_r = met.groupBy("r_ord").agg(F.sum("n_s").alias("asked"))
    judged = per_s.join(per_r, "r_ord").select(F.col("s_ord").alias("first"), F.when((F.col("found") == 1) & (F.col("asked") == 1), F.col("r_ord")).alias("r_ord"))
    members = s.select("ord", *same)
    firsts = members.groupBy(*same).agg(F.min("ord").alias("first")).join(judged, "first").withColumnsRenamed({c: f"of_{c}" for c in same})
    agree = [F.col(c) == F.col(f"of_{c}") for c in (*KEY, "cents")] + [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("parcela", "numero_parcelas")]
    return members.join(firsts, agree).select(F.col("ord").alias("s_ord"), "r_ord", F.when(F.col("r_ord").isNotNull(), F.lit(REVIEW)).otherwise(F.lit(AMBIGUOUS)).alias("kind"))

"""Matching two prepared sides: consolidation, quality, assignment, the second stage, and what is left over."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import assign, classify, consolidate, fallback, impact, quality, rollup, schema
from ledgerloom.operators.keeping import keep


@dataclass
class Result:
    """What a reconciliation gives. detail holds its order in stage and emit; counters are (indicador, valor) rows.

    consolidated, ledger, quality, discards and detail are made when they are first asked for: what only counts rows pays for no
    assignment, and the counts of a run write no wide rows. reasons: counts of discards (rollup.discard_reasons).
    """

    acquirer: DataFrame
    consolidate: Callable[[], DataFrame]
    original_ledger_rows: DataFrame
    coded: Callable[[DataFrame], DataFrame]
    gone: Callable[[], DataFrame] | None = None
    reasons: DataFrame | None = None
    counters: DataFrame | None = None
    per_file: DataFrame | None = None
    context: dict = field(default_factory=dict)

    @cached_property
    def consolidated(self) -> DataFrame:
        return self.consolidate()

    @cached_property
    def discards(self) -> DataFrame | None:
        return self.gone() if self.gone else None

    @cached_property
    def ledger(self) -> DataFrame:
        """The consolidated rows with their quality codes."""
        return self.coded(self.consolidated)

    @cached_property
    def quality(self) -> DataFrame:
        return quality.report(self.ledger)

    @cached_property
    def decided(self) -> tuple[DataFrame, DataFrame]:
        """What the assignment and the second stage found, as kept tables."""
        return _decided(self.consolidated, self.acquirer)

    @cached_property
    def detail(self) -> DataFrame:
        return _paired(self).union(_left_over(self))

    @cached_property
    def detail_in_order(self) -> DataFrame:
        """The detail report by stage and emit. Rows are ordered before they are judged: what a report is made of is far narrower than the report."""
        return _paired(self, in_order=True).union(_left_over(self, in_order=True))  # the acquirer rows that are left are the last stage

    def not_at_acquirer(self) -> DataFrame:
        """The detail report's rows whose statuses hold NOT_AT_ACQUIRER, which few cases give: the rows of these cases are all that is judged."""
        return _paired(self, [name for name, row in classify.CASES.items() if classify.NOT_AT_ACQUIRER in row[1].split(",")])

    def not_in_ledger(self) -> DataFrame:
        """The detail report's rows whose statuses hold NOT_IN_LEDGER: the acquirer rows that are left, which need nothing of the ledger's rows."""
        return _left_over(self, self.consolidated.withColumn("codes", F.lit(None).cast("array<string>")))

    def summary(self) -> DataFrame:
        """indicador and valor, all numeric ones."""
        kind = "decimal(38,2)"
        parts = [row_counts(self), rollup.status_counts(self.detail), rollup.money_totals(self.acquirer, self.consolidated), rollup.impact_totals(self.detail), discount_total(self.consolidated)]
        if self.counters is not None:
            parts.append(self.counters)
        return reduce(DataFrame.union, (p.select("indicador", F.col("valor").cast(kind).alias("valor")) for p in parts))

    def groupings(self) -> DataFrame:
        """indicador, chave and quantidade: the counts by brand, modality, payment form and status."""
        own = [rollup.value_counts(self.consolidated, c).select(F.lit(f"quantidade_por_{c}_shift").alias("indicador"), F.col("valor").alias("chave"), "quantidade") for c in ("bandeira", "modalidade", "forma_pagamento")]
        by_status = rollup.totals_by_status(self.detail).select(F.lit("totais_por_status_conciliacao"), "status", "quantidade")
        return reduce(DataFrame.union, [*own, by_status])

    def audit(self) -> DataFrame:
        if self.discards is None or self.counters is None:
            raise ValueError("a match of two tables has no discards or counters; reconcile() gives them")
        return rollup.audit(self.counters, self.discards, self.per_file)


def discount_total(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("valor_desconto"), F.lit(0)).alias("valor")).select(F.lit("valor_desconto_total_shift").alias("indicador"), "valor")


def row_counts(result: Result) -> DataFrame:
    """Rows of either side, before and after consolidation."""
    a = result.acquirer.agg(F.count("*").alias("total_linhas_rede"))
    after = result.consolidated.agg(F.count("*").alias("total_linhas_shift"), F.count_if("_grouped").alias("total_agrupamentos_shift"))
    before = result.original_ledger_rows.agg(F.count("*").alias("total_linhas_shift_originais"))
    one = a.crossJoin(after).crossJoin(before)  # one row each
    grouped = (F.col("total_linhas_shift_originais") - F.col("total_linhas_shift") + F.col("total_agrupamentos_shift")).alias("total_linhas_agrupadas_shift")
    return rollup._turned(one.select("*", grouped), "bigint")


def refuse_empty(no_a: bool, no_l: bool) -> None:
    if no_a or no_l:
        who = "Os dois arquivos estão vazios" if no_a and no_l else "O arquivo da Rede está vazio" if no_a else "O arquivo do Shift está vazio"
        raise ValueError(f"{who} ou a aba selecionada não contém dados válidos.")


def match(acquirer: DataFrame, ledger: DataFrame, check_empty: bool = True, kept: bool = False, consolidated: DataFrame | None = None, coded: Callable[[], DataFrame] | None = None) -> Result:
    """Match canonical sides (schema.acquirer and schema.ledger complete them). kept: both are tables already, which several branches may read.
    consolidated, coded: the table of the consolidated ledger, and what gives the one with its codes, if there are such.

    Sides have a unique ord of 0 or more.
    """
    a, original = schema.acquirer(acquirer), schema.ledger(ledger)
    if not kept:
        a, original = keep(a, "acquirer"), keep(original, "ledger")
    if check_empty:
        refuse_empty(a.isEmpty(), original.isEmpty())
    one = (lambda: keep(consolidate.consolidated(original), "consolidated")) if consolidated is None else (lambda: consolidated)
    return Result(a, one, original, (lambda _: coded()) if coded else quality.with_codes)


def _decided(consolidated: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outcome of each ledger row whose key the acquirer has, and the kinds of those that the second stage finds rows for."""
    clear = consolidated.where("not _ambiguous")
    outcome = keep(assign.assigned(clear, a), "outcome")
    settled = outcome.where(F.col("outcome") != assign.NONE_FREE).select(F.col("s_ord").alias("ord"))
    # the second stage begins when every key has been assigned
    pending = clear.where("not _grouped").join(settled, "ord", "left_anti")
    return outcome, keep(fallback.classified(pending, a, _taken(outcome)), "kinds")


def _taken(outcome: DataFrame) -> DataFrame:
    return outcome.where("r_ord is not null").select(F.col("r_ord").alias("ord"))


def _of_ledger(rows: DataFrame, outcome: DataFrame, kinds: DataFrame) -> DataFrame:
    """Each ledger row with its case and its acquirer row, if it has one."""
    first = outcome.select(F.col("s_ord").alias("ord"), F.col("r_ord").alias("_first"), "outcome")
    second = kinds.select(F.col("s_ord").alias("ord"), F.col("r_ord").alias("_second"), "kind")
    case = (
        F.when(F.col("_ambiguous"), F.lit(classify.CONFLICTING)).when(F.col("outcome") == assign.SEVERAL, F.lit(classify.SEVERAL)).when(F.col("outcome") == assign.TAKEN, F.lit(classify.PAIRED))
        .when(F.col("_grouped"), F.lit(classify.GROUP_ALONE)).otherwise(F.coalesce("kind", F.lit(fallback.NOTHING)))
    )
    # a ledger row without a partner gets a number that no acquirer row has: as nulls they would all meet in one task
    partner = F.coalesce("_first", "_second", -1 - F.col("ord"))
    return rows.join(first, "ord", "left").join(second, "ord", "left").select(*rows.columns, case.alias("_case"), partner.alias("_partner"))


def _partners(outcome: DataFrame, kinds: DataFrame) -> DataFrame:
    """The acquirer rows that have a ledger row: kept tables of known size, so few of them go to all tasks, and no acquirer row is moved."""
    return _taken(outcome).union(kinds.where("r_ord is not null").select(F.col("r_ord").alias("ord")))


def _report(joined: DataFrame, case: Column) -> DataFrame:
    return impact.with_impact(classify.detail(classify.judged(joined, case)))


def _paired(result: Result, alone: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """The detail report of ledger rows with their codes. alone: only those of these cases, which have no acquirer row."""
    own, a = _of_ledger(result.ledger, *result.decided), result.acquirer
    if alone is None:
        joined = own.alias("s").join(a.join(_partners(*result.decided), "ord", "left_semi").alias("r"), F.col("s._partner") == F.col("r.ord"), "left")
    else:  # chosen before they are judged: a filter on the statuses would be worked out with all that they are made of, again and again
        joined = own.where(F.col("_case").isin(*alone)).alias("s").join(a.alias("r"), F.lit(False), "left")
    return _report(joined.orderBy(classify.stage(F.col("s._case")), "s.ord") if in_order else joined, F.col("s._case"))


def _left_over(result: Result, rows: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """The detail report of the acquirer rows that are left. They have nothing to be joined with: as a branch of their own they move no more
    than their numbers, and what is the same for all of them costs nothing. rows: what has the ledger's columns (nulls here)."""
    own = _of_ledger(result.ledger if rows is None else rows, *result.decided)
    joined = own.alias("s").join(result.acquirer.join(_partners(*result.decided), "ord", "left_anti").alias("r"), F.lit(False), "right")
    return _report(joined.orderBy("r.ord") if in_order else joined, F.lit(classify.LEFT_OVER))

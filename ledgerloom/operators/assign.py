"""One-to-one assignment of ledger rows to acquirer rows of the same authorisation.

Rows compete only within their own match key, so the greedy assignment (ledger rows in order, each takes its best free
candidate) is exact when made key by key. Keys are dealt with by their size, which is counted first:

- A key with a single ledger row has no contest: its acquirer rows are joined and reduced to the best one with map-side
  aggregation, so any number of them is fine.
- A key of at most SMALL pairs is folded in the JVM: its scored pairs become one sorted list of candidates for each ledger row,
  and the ledger rows take their turns along it. No group has more pairs than that.
- A larger key falls apart into runs of near values (no two of them within the tolerance), as a row of near value comes before
  all others. Each run is swept by itself, so that a hot key's rows spread over tasks. If every ledger row finds a free row of
  near value at its turn, no row ever looks outside its run, and the runs' assignments are the key's.
- A consolidated row asks only how many rows are free at its turn, which a count tells: every ordinary row before it took one,
  as long as there was one. So at most one consolidated row of a key takes a row, the one that is left, and none after it does.
- Where an ordinary row finds nothing near, the key is swept as a whole: rows stream through one task in order, each choice a
  few look-ups among queues of free rows. Such a choice may take the row that the next one wants,
  and that one the row of the one after it, all along the key: no rounds of proposals end sooner than the sweep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import MATCH_KEY, criterion, staged
from ledgerloom.functions.installments import CRITERIA
from ledgerloom.operators.keeping import keep, keep_counted

TOLERANCE = "0.02"
CENTS = 2
#: Keys of so many pairs of rows at most are folded.
SMALL = 4096
#: So many keys of ledger rows at most are sent to all tasks, where acquirer rows of other keys then leave before they are moved.
FEW = 1 << 18
SCORED = ("valor_bruto", "parcela", "numero_parcelas", "nsu", "data_venda")
#: What became of a ledger row.
TAKEN, NONE_FREE, SEVERAL = "taken", "none", "several"


def tolerance() -> Column:
    return F.lit(TOLERANCE).cast("decimal(4,2)")


def score(s: Column, r: Column) -> Column:
    """What orders candidates: value within tolerance, instalments, NSU, date; then the first acquirer row."""
    rank = F.lit(-1)
    how = criterion(s["parcela"], s["numero_parcelas"], r["parcela"], r["numero_parcelas"])
    for k, name in enumerate(CRITERIA):
        rank = F.when(how == name, F.lit(k)).otherwise(rank)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        yes(F.abs(s["valor_bruto"] - r["valor_bruto"]) <= tolerance()).alias("value"),
        rank.alias("installments"),
        yes((s["nsu"] == r["nsu"]) & (s["nsu"] != "")).alias("nsu"),
        yes(s["data_venda"] == r["data_venda"]).alias("date"),
        (-r["ord"]).alias("first"),
    )


def with_key(side: DataFrame) -> DataFrame:
    """side with auth_key, what its authorisations are joined on: tables that hold it needn't work it out again."""
    return staged(side, {"auth_key": (MATCH_KEY, F.col("autorizacao"))})


def _keyed(side: DataFrame, *more: str) -> DataFrame:
    """auth_key and the columns that scores need, of rows that have a key."""
    if "auth_key" in side.columns:
        return side.where("auth_key is not null").select("ord", *SCORED, *more, "auth_key")
    return with_key(side.select("ord", "autorizacao", *SCORED, *more)).where("auth_key is not null").drop("autorizacao")


def candidate_scores(ledger: DataFrame, acquirer: DataFrame) -> DataFrame:
    """Every pair of rows with equal match keys, with its score: for inspection. assigned() makes no such pairs."""
    s = _keyed(ledger).select("auth_key", F.struct("ord", *SCORED).alias("s"))
    r = _keyed(acquirer).select("auth_key", F.struct("ord", *SCORED).alias("r"))
    return s.join(r, "auth_key").select("auth_key", F.col("s.ord").alias("s_ord"), F.col("r.ord").alias("r_ord"), score(F.col("s"), F.col("r")).alias("score"))


def assigned(ledger: DataFrame, acquirer: DataFrame) -> DataFrame:
    """s_ord, r_ord and outcome of each ledger row whose key the acquirer has. ledger has _grouped. Sides with auth_key (see with_key) are read as tables; of others the keyed rows are kept."""
    s, r = _keyed(ledger, "_grouped"), _keyed(acquirer)
    s, r = s if "auth_key" in ledger.columns else keep(s, "choosing"), r if "auth_key" in acquirer.columns else keep(r, "offered")
    by_key, n = keep_counted(s.groupBy("auth_key").agg(F.count("*").alias("n"), F.any_value(F.struct("ord", *SCORED, "_grouped")).alias("s")), "keys")
    if n["n"] <= FEW:  # no acquirer row of another key is moved
        r = r.join(F.broadcast(by_key.select("auth_key")), "auth_key", "left_semi")
    sizes = keep(by_key.where("n > 1").drop("s").join(r.groupBy("auth_key").agg(F.count("*").alias("m")), "auth_key"), "contested")
    out = _uncontested(by_key.where("n = 1").drop("n"), r).unionByName(_folded(s, r, sizes.where(F.col("n") * F.col("m") <= SMALL).select("auth_key")))
    large = sizes.where(F.col("n") * F.col("m") > SMALL)
    return out if large.isEmpty() else out.unionByName(_swept(s, r, large))


def _uncontested(single: DataFrame, r: DataFrame) -> DataFrame:
    pairs = single.join(r.select("auth_key", F.struct("ord", *SCORED).alias("r")), "auth_key")
    best = pairs.select(F.col("s.ord").alias("s_ord"), F.col("s._grouped").alias("grouped"), score(F.col("s"), F.col("r")).alias("score")).groupBy("s_ord").agg(F.count("*").alias("free"), F.max("score").alias("best"), F.any_value("grouped").alias("grouped"))
    several = F.col("grouped") & (F.col("free") > 1)
    return best.select("s_ord", F.when(~several, -F.col("best.first")).alias("r_ord"), F.when(several, F.lit(SEVERAL)).otherwise(F.lit(TAKEN)).alias("outcome"))


def _folded(s: DataFrame, r: DataFrame, keys: DataFrame) -> DataFrame:
    """The assignment of keys of few pairs, each key one row."""
    choosing = s.join(keys, "auth_key", "left_semi").select("auth_key", F.struct("ord", *SCORED, "_grouped").alias("s"))
    pairs = choosing.join(r.select("auth_key", F.struct("ord", *SCORED).alias("r")), "auth_key").select("auth_key", F.col("s.ord").alias("s_ord"), F.col("s._grouped").alias("grouped"), score(F.col("s"), F.col("r")).alias("score"))
    lists = pairs.groupBy("auth_key", "s_ord", "grouped").agg(F.sort_array(F.collect_list("score"), asc=False).alias("wanted"))
    lists = lists.withColumn("wanted", F.transform("wanted", lambda x: -x["first"]))
    turns = lists.groupBy("auth_key").agg(F.array_sort(F.collect_list(F.struct("s_ord", "grouped", "wanted"))).alias("turns"))
    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<s_ord:bigint,r_ord:bigint,outcome:string>>").alias("out"))

    def turn(acc: Column, x: Column) -> Column:
        free = F.array_except(x["wanted"], acc["used"])  # keeps the order, and acquirer rows are unique
        outcome = F.when(F.size(free) == 0, F.lit(NONE_FREE)).when(x["grouped"] & (F.size(free) > 1), F.lit(SEVERAL)).otherwise(F.lit(TAKEN))
        pick = F.when(outcome == TAKEN, F.get(free, F.lit(0)))
        used = F.when(pick.isNotNull(), F.array_append(acc["used"], pick)).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.array_append(acc["out"], F.struct(x["s_ord"].alias("s_ord"), pick.alias("r_ord"), outcome.alias("outcome"))).alias("out"))

    return turns.select(F.inline(F.aggregate("turns", start, turn)["out"]))


def _swept(s: DataFrame, r: DataFrame, sizes: DataFrame) -> DataFrame:
    """The assignment of large keys: run by run of near values, and whole where that isn't enough."""
    of_key = sizes.select("auth_key", "m")
    plain = lambda df, side, grouped: df.join(of_key, "auth_key").select(
        "auth_key", F.lit(side).alias("side"), "ord", (F.col("valor_bruto") * 100).cast("decimal(38,0)").alias("cents"), "parcela", "numero_parcelas", F.nullif("nsu", F.lit("")).alias("nsu"), F.unix_date("data_venda").alias("day"), grouped.alias("grouped"), "m"
    )
    both = keep(plain(r, 0, F.lit(False)).unionByName(plain(s, 1, F.col("_grouped"))), "large")
    asked = keep(_by_counts(both), "asked")
    values = both.where("cents is not null").groupBy("auth_key", "cents").agg(F.count("*").alias("n")).drop("n")
    by_value = Window.partitionBy("auth_key").orderBy("cents")
    starts = F.coalesce(F.col("cents") - F.lag("cents").over(by_value) > CENTS, F.lit(True)).cast("long")
    runs = keep(values.withColumn("begins", starts).withColumn("run", F.sum("begins").over(by_value)).drop("begins"), "runs")
    choosing = both.where("side = 1").join(asked.where("outcome is null").select("auth_key", "ord"), ["auth_key", "ord"], "left_semi")
    placed = both.where("side = 0").unionByName(choosing).join(runs, ["auth_key", "cents"])
    columns = ("auth_key", "run", "side", "ord", "cents", "parcela", "numero_parcelas", "nsu", "day", "grouped")
    # by a hash of the key: by the key itself, the planner may take the joins' partitions below for it, although adaptive execution reads them differently
    dealt = placed.select(*columns).repartition(F.xxhash64("auth_key", "run")).sortWithinPartitions("auth_key", "run", "side", "ord")
    within = keep(dealt.mapInArrow(_within_runs, _CHOSEN), "within")
    unsettled = keep(within.where("outcome is null").select("auth_key").union(choosing.where("cents is null").select("auth_key")).distinct(), "unsettled")
    settled = within.join(unsettled, "auth_key", "left_anti")
    by_count = asked.where("outcome is not null").join(unsettled, "auth_key", "left_anti")
    # where a consolidated row takes the last free row, it is the only one that no run gave away
    last = by_count.where(F.col("outcome") == TAKEN).select("auth_key")
    left = both.where("side = 0").join(last, "auth_key", "left_semi").join(settled.select("auth_key", F.col("r_ord").alias("ord")), ["auth_key", "ord"], "left_anti").select("auth_key", F.lit(TAKEN).alias("outcome"), F.col("ord").alias("r_ord"))
    counted = by_count.join(left, ["auth_key", "outcome"], "left").select(F.col("ord").alias("s_ord"), "r_ord", "outcome")
    whole = both.join(unsettled, "auth_key", "left_semi").withColumn("run", F.lit(0).cast("bigint")).select(*columns)
    swept = whole.repartition(F.xxhash64("auth_key")).sortWithinPartitions("auth_key", "side", "ord").mapInArrow(_along_keys, _CHOSEN)
    return settled.drop("auth_key").unionByName(counted).unionByName(swept.drop("auth_key"))


def _by_counts(both: DataFrame) -> DataFrame:
    """auth_key, ord and outcome of each ledger row, as far as counts tell it: null for the ordinary rows that find a free row, whichever it is."""
    turns = Window.partitionBy("auth_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ledger = both.where("side = 1").withColumn("ordinary", F.count_if(~F.col("grouped")).over(turns))  # of the key, up to this row
    last = ledger.where("grouped and ordinary = m - 1").groupBy("auth_key").agg(F.min("ord").alias("last"))
    of_group = F.when(F.col("ord") == F.col("last"), F.lit(TAKEN)).when(F.col("ordinary") < F.col("m") - 1, F.lit(SEVERAL)).otherwise(F.lit(NONE_FREE))
    too_late = F.col("ordinary") > F.col("m") - F.col("last").isNotNull().cast("long")
    outcome = F.when(F.col("grouped"), of_group).when(too_late, F.lit(NONE_FREE))
    return ledger.join(last, "auth_key", "left").select("auth_key", "ord", outcome.alias("outcome"))


_CHOSEN = "auth_key string, s_ord bigint, r_ord bigint, outcome string"


def _within_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _chosen(batches, near_only=True)


def _along_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _chosen(batches, near_only=False)


def _chosen(batches: Iterator[pa.RecordBatch], near_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (auth_key, run, side, ord): acquirer rows become free, then ledger rows choose. near_only: where no free row is near, the outcome is null."""
    key, free = None, Free()
    for batch in batches:
        out: list[tuple[str, int, int | None, str | None]] = []
        for auth_key, run, side, ord_, cents, current, total, nsu, day, grouped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (auth_key, run) != key:
                key, free = (auth_key, run), Free()
            cents = None if cents is None else int(cents)
            if side == 0:
                free.add(ord_, cents, current, total, nsu, day)
            elif near_only:
                pick = free.take(cents, current, total, nsu, day, near_only)
                out.append((auth_key, ord_, pick, TAKEN if pick is not None else None))
            elif not free.n:
                out.append((auth_key, ord_, None, NONE_FREE))
            elif grouped and free.n > 1:
                out.append((auth_key, ord_, None, SEVERAL))
            else:
                out.append((auth_key, ord_, free.take(cents, current, total, nsu, day), TAKEN))
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["auth_key", "s_ord", "r_ord", "outcome"])


class Free:
    """The free acquirer rows of one key, in queues by what a score looks at. Rows come in order, so every queue is in order too."""

    def __init__(self) -> None:
        self.n = 0
        self.taken: set[int] = set()
        #: (cents, or None for all rows) -> (instalment, total) -> what else must agree -> the numbers of the rows
        self.queues: dict[int | None, dict[tuple, dict[tuple, Queue]]] = {}

    def add(self, ord_: int, cents: int | None, current: int | None, total: int | None, nsu: str | None, day: int | None) -> None:
        self.n += 1
        agree = [(None, None)]
        agree += [(nsu, None)] if nsu is not None else []
        agree += [(None, day)] if day is not None else []
        agree += [(nsu, day)] if nsu is not None and day is not None else []
        for scope in {None, cents}:
            queues = self.queues.setdefault(scope, {}).setdefault((current, total), {})
            for x in agree:
                queues.setdefault(x, Queue()).rows.append(ord_)

    def take(self, cents: int | None, current: int | None, total: int | None, nsu: str | None, day: int | None, near_only: bool = False) -> int | None:
        """The best free row, or the best of near value; None if there is none."""
        near = [] if cents is None else [cents + d for d in range(-CENTS, CENTS + 1)]
        ranked: dict[int, list[dict[tuple, Queue]]] = {}
        for scopes in (near,) if near_only else (near, [None]):
            for scope in scopes:
                for installments, queues in self.queues.get(scope, {}).items():
                    if queues[None, None].first(self.taken) is not None:
                        ranked.setdefault(_rank(current, total, *installments), []).append(queues)
            if ranked:
                break
        if not ranked:
            return None
        best = ranked[max(ranked)]
        wanted = [(nsu, day)] if nsu is not None and day is not None else []
        wanted += [(nsu, None)] if nsu is not None else []
        wanted += [(None, day)] if day is not None else []
        for x in [*wanted, (None, None)]:
            found = [first for queues in best if x in queues and (first := queues[x].first(self.taken)) is not None]
            if found:
                break
        self.taken.add(min(found))
        self.n -= 1
        return min(found)


class Queue:
    __slots__ = ("rows", "at")

    def __init__(self) -> None:
        self.rows: list[int] = []
        self.at = 0

    def first(self, taken: set[int]) -> int | None:
        while self.at < len(self.rows) and self.rows[self.at] in taken:
            self.at += 1
        return self.rows[self.at] if self.at < len(self.rows) else None


def _rank(current_a: int | None, total_a: int | None, current_b: int | None, total_b: int | None) -> int:
    """The place in CRITERIA, as functions.criterion has it."""
    remaining = [t - c if c is not None and t is not None and 0 < c <= t else None for c, t in ((current_a, total_a), (current_b, total_b))]
    if None in remaining:
        return 1
    if (current_a, total_a) == (current_b, total_b):
        return 3
    return 2 if remaining[0] == remaining[1] else 0

"""The assignment of every size of key against a plain loop over ledger rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import assign, consolidate, schema

OWN = "ord bigint, autorizacao string, valor_bruto decimal(28,2), parcela int, numero_parcelas int, nsu string, data_venda date"


def frames(spark, ledger, acquirer):
    kept = lambda rows, kind: spark.createDataFrame([tuple(r.values()) for r in rows], f"ord bigint, autorizacao string, bruto double, parcela int, numero_parcelas int, nsu string, dia string{kind}").withColumns({"valor_bruto": F.col("bruto").cast("decimal(28,2)"), "data_venda": F.to_date("dia")})
    return kept(ledger, ", _grouped boolean"), kept(acquirer, "")


def plain(ledger, acquirer):
    free, out = defaultdict(list), []
    for r in sorted(acquirer, key=lambda r: r["ord"]):
        free[r["key"]].append(r)
    known = set(free)
    for s in sorted(ledger, key=lambda s: s["ord"]):
        left = free[s["key"]]
        if s["key"] not in known:
            continue
        if not left:
            out.append((s["ord"], None, "none"))
        elif s["grouped"] and len(left) > 1:
            out.append((s["ord"], None, "several"))
        else:

            def wanted(r, s=s):
                near = s["value"] is not None and r["value"] is not None and abs(round(s["value"] * 100) - round(r["value"] * 100)) <= 2
                return near, assign._rank(s["current"], s["total"], r["current"], r["total"]), bool(s["nsu"]) and s["nsu"] == r["nsu"], s["day"] is not None and s["day"] == r["day"], -r["ord"]

            best = max(left, key=wanted)
            left.remove(best)
            out.append((s["ord"], best["ord"], "taken"))
    return sorted(out, key=str)


def row(rng, ord_, key, grouped=None):
    pick = lambda *of: rng.choice(of)
    own = {"ord": ord_, "key": key, "value": pick(None, 1.0, 1.01, 1.02, 1.05, 2.0, 7.5), "current": pick(None, 1, 2, 3), "total": pick(None, 2, 3, 4), "nsu": pick(None, "", "7", "8"), "day": pick(None, "2025-01-01", "2025-01-02")}
    return own if grouped is None else own | {"grouped": grouped}


@pytest.mark.parametrize("small", [0, 6, 4096])
def test_against_a_plain_loop(spark, monkeypatch, small):
    monkeypatch.setattr(assign, "SMALL", small)
    rng = random.Random(small)
    keys = [f"{k}" for k in range(100001, 100031)]
    ledger = [row(rng, k, rng.choice(keys), rng.random() < 0.1) for k in range(220)] + [row(rng, 1000 + k, "hot", k > 60) for k in range(70)]
    acquirer = [row(rng, k, rng.choice(keys[:25])) for k in range(240)] + [row(rng, 1000 + k, "hot") for k in range(62)]
    got = sorted((tuple(r) for r in assign.assigned(*frames(spark, ledger, acquirer)).collect()), key=str)
    assert got == plain([r | {"key": r["key"].upper()} for r in ledger], [r | {"key": r["key"].upper()} for r in acquirer])


def test_a_hot_key_of_200000_rows_falls_apart(spark, monkeypatch):
    """One authorisation, 100,000 rows on either side, three of each value: no sweep along the key is needed."""
    n = 100_000
    side = lambda shift: spark.range(n).select((F.col("id") * 7919 % n).alias("ord"), F.lit("000001").alias("autorizacao"), F.expr("cast(id div 3 as decimal(28,2))").alias("valor_bruto"), (F.col("id") % 3 + shift).cast("int").alias("parcela"), F.lit(5).alias("numero_parcelas"), F.col("id").cast("string").alias("nsu"), F.lit("2025-01-01").cast("date").alias("data_venda"))
    monkeypatch.setattr(assign, "_along_keys", lambda batches: (b for b in batches if 1 / (0 * b.num_rows)))
    got = assign.assigned(side(1).withColumn("_grouped", F.lit(False)), side(1))
    assert got.where("outcome = 'taken' and s_ord = r_ord").count() == n and got.count() == n


@pytest.mark.parametrize("extra", [-30, -1, 0, 1, 40])
def test_consolidated_rows_of_a_large_key_need_counts_only(spark, monkeypatch, extra):
    """Consolidated rows anywhere in the order, and fewer, as many or more acquirer rows than ordinary ledger rows: nothing is swept whole."""
    monkeypatch.setattr(assign, "SMALL", 0)
    monkeypatch.setattr(assign, "_along_keys", lambda batches: (b for b in batches if 1 / (0 * b.num_rows)))
    rng = random.Random(extra)
    ledger = [row(rng, k, f"{100000 + k % 7}", rng.random() < 0.15) | {"value": rng.choice((1.0, 1.01, 1.02))} for k in range(700)]
    acquirer = []
    for key in sorted({r["key"] for r in ledger}):
        n = max(1, sum(r["key"] == key and not r["grouped"] for r in ledger) + extra)
        acquirer += [row(rng, 1000 * int(key) + k, key) | {"value": rng.choice((1.0, 1.01, 1.02))} for k in range(n)]
    got = sorted((tuple(r) for r in assign.assigned(*frames(spark, ledger, acquirer)).collect()), key=str)
    assert got == plain(ledger, acquirer)
    assert {x[2] for x in got} == ({"taken", "several"} if extra > 1 else {"taken", "several", "none"})


def test_a_hot_key_that_is_swept_as_a_whole(spark):
    """Each ledger row but the first takes what the next one wants: only the order of all rows tells."""
    n = 20_000
    own = lambda: spark.range(n).select(F.col("id").alias("ord"), F.lit("000001").alias("autorizacao"), F.col("id").cast("decimal(28,2)").alias("valor_bruto"), F.lit(1).alias("parcela"), F.lit(1).alias("numero_parcelas"), F.lit(None).cast("string").alias("nsu"), F.lit(None).cast("date").alias("data_venda"))
    ledger = own().withColumn("valor_bruto", F.when(F.col("ord") == 0, F.lit(-5)).otherwise(F.col("valor_bruto")).cast("decimal(28,2)")).withColumn("_grouped", F.lit(False))
    got = {r["s_ord"]: r["r_ord"] for r in assign.assigned(ledger, own().where("ord > 0")).collect()}
    assert got == {k: k + 1 for k in range(n - 1)} | {n - 1: None}


def test_a_hot_group_is_put_together_in_two_levels(spark):
    """100,000 service orders of one authorisation: the lists are in order, the sums whole."""
    n = 100_000
    ledger = schema.ledger(spark.range(n).select((F.col("id") * 7919 % n).alias("ord"), (F.col("id") * 7919 % n).alias("_row"), F.lit("000001").alias("autorizacao"), F.expr("cast(0.01 as decimal(28,2))").alias("valor_bruto"), F.concat(F.lit("O"), (F.col("id") * 7919 % n).cast("string")).alias("os_shift")))
    one = consolidate.consolidated(ledger).collect()
    assert len(one) == 1 and one[0]["_linhas_agrupadas_shift"] == n and one[0]["valor_bruto"] == n // 100 and one[0]["ord"] == consolidate.AFTER
    assert one[0]["_rows_agrupadas"] == ", ".join(map(str, range(n))) and one[0]["_os_shift_agrupadas"].startswith("O0 | O1 | O2") and one[0]["_descricoes_originais_agrupadas"] == ""

"""What queries move and read: no more rows than the question needs, with the same results."""

import os

from pyspark.sql import functions as F
from test_matching import side

from ledgerloom.operators import assign, classify, consolidate, fallback, keeping, schema
from ledgerloom.plans import matching, queries, sides

FOLDER = "/root/testdata/sf0.001"


def _kept(spark):
    folder = keeping.shared_folder(spark)
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_side_l_alone_makes_no_side_a(spark):  # F10
    keeping.clear(spark)
    alone = sides.ledger(spark, FOLDER).where("ord is not null")
    assert not any(name.startswith("acquirer-") for name in _kept(spark)) and not keeping.is_made(spark, "acquirer", sides._inputs(FOLDER))
    rows = spark.createDataFrame(alone.collect(), alone.schema)
    keeping.clear(spark)
    a = sides.acquirer(spark, FOLDER)
    of_a = sides.ledger(spark, FOLDER)
    assert a.count() and of_a.schema.simpleString() == rows.schema.simpleString()
    assert rows.count() == of_a.count() and rows.exceptAll(of_a).isEmpty() and of_a.exceptAll(rows).isEmpty()


def test_acquirer_rows_that_are_left_meet_no_ledger_row(spark):  # F8, F9, F11 to F16
    values = [{"autorizacao": f"{k:06d}"} for k in range(1, 40)]
    ledger = [{"autorizacao": "000001"}, {"autorizacao": "000002", "bruto": "11,00"}, {"autorizacao": "Z00009"}, {"autorizacao": "Z00008", "bruto": "77,00"}]
    result = matching.match(side(spark, "rede", *values), side(spark, "shift", *ledger))
    plan = result.detail._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "RightOuter" not in plan and "LeftAnti" in plan
    rows = result.detail.collect()
    left = [r for r in rows if r["tipo_correspondencia"] == classify.LEFT_OVER]
    assert len(left) == 37 and all(r["statuses"] == [classify.NOT_IN_LEDGER] and r["linha_shift"] is None and r["quantidade_os_agrupadas"] is None for r in left)
    assert {r["autorizacao_rede_normalizada"] for r in left} == {f"{k:06d}" for k in range(3, 40)} and len(rows) == 41


def test_few_waiting_rows_call_free_rows_by_key(spark, monkeypatch):  # F20
    free = side(spark, "rede", {"liquido": "9,00"}, {"liquido": "9,01"}, {"bruto": "12,00", "liquido": "9,00"}, {"dia": "2025-11-27", "liquido": "9,00"}, {"bruto": "13,00", "liquido": "9,00"})
    waiting = side(spark, "shift", {"liquido": "9,00"}, {"bruto": "13,00", "liquido": "9,02"}, {"bruto": "14,00", "liquido": "9,00"})
    found = {}
    for few in (fallback.FEW, 0):
        monkeypatch.setattr(fallback, "FEW", few)
        pairs, kinds = fallback.candidates(waiting, free), fallback.classified(waiting, free)
        found[few] = sorted(map(tuple, pairs.collect())), sorted(map(tuple, kinds.select("s_ord", "kind", F.coalesce("r_ord", F.lit(-1))).collect()))
        assert ("LeftSemi" in pairs._jdf.queryExecution().optimizedPlan().toString()) == (few > 0)
    first, second = found.values()
    assert first == second == ([(0, 0), (0, 1), (1, 4)], [(0, fallback.AMBIGUOUS, -1), (1, fallback.REVIEW, 4)])


def _marks_of(spark, folder, few, monkeypatch):
    monkeypatch.setattr(consolidate, "FEW", few)
    before = _kept(spark)
    rows = consolidate.flagged(schema.ledger(queries._ledger(spark, folder)[0]))
    plan, columns = rows._jdf.queryExecution().optimizedPlan().toString(), rows.columns
    return plan, columns, sorted(map(tuple, rows.where("_ambiguous or _repeated").select("ord", "_ambiguous", "_repeated").collect())), {name.split("-")[0] for name in _kept(spark) - before}


def test_consolidation_moves_no_ledger_row_where_few_authorisations_are_shared(spark, monkeypatch):  # F14, F15, F21
    sides.ledger(spark, FOLDER)
    few, many = _marks_of(spark, FOLDER, consolidate.FEW, monkeypatch), _marks_of(spark, FOLDER, 0, monkeypatch)
    assert few[3] == {"shared", "twins"} and many[3] == {"shared", "twins", "marks"} and "broadcast" in few[0]
    assert few[1] == many[1] and few[2] == many[2] and {x[1:] for x in few[2]} == {(True, False), (False, True)}


def test_marks_of_shared_authorisations(spark, monkeypatch):  # F14, F15, F21
    own = [("a", "o1", "VISA"), ("a", "o2", "VISA"), ("a", "o2", "VISA"), ("b", "o1", "VISA"), ("b", "o2", None), ("c", "o1", "VISA"), (None, "o1", "ELO"), (None, "o2", "ELO"), ("d", None, None), ("d", "o1", None), ("e", "o1", "ELO"), ("e", "o1", "ELO")]
    ledger = schema.ledger(spark.createDataFrame([(k, *x) for k, x in enumerate(own)], "ord bigint, autorizacao string, os_shift string, bandeira string"))
    for few in (consolidate.FEW, 0):
        monkeypatch.setattr(consolidate, "FEW", few)
        got = {r["ord"]: (r["_ambiguous"], r["_repeated"], r["_group"]) for r in consolidate._marked(ledger).collect()}
        none = (False, False, None)
        assert got == {0: (False, False, 0), 1: (False, True, 0), 2: (False, True, 0), 3: (True, False, None), 4: (True, False, None), 5: none, 6: (False, False, 6), 7: (False, False, 6), 8: none, 9: none, 10: (False, True, None), 11: (False, True, None)}


def test_acquirer_rows_of_other_keys_leave_before_the_assignment(spark, monkeypatch):  # F21
    a, l = sides.acquirer(spark, FOLDER), sides.ledger(spark, FOLDER).withColumn("_grouped", F.lit(False))  # noqa: E741
    found = {}
    for few in (assign.FEW, 0):
        monkeypatch.setattr(assign, "FEW", few)
        out = assign.assigned(l, a)
        found[few] = sorted((r["s_ord"], r["r_ord"] or -1, r["outcome"]) for r in out.collect())
        assert ("strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == (few > 0)
    first, second = found.values()
    assert first == second and len(first) > 500


def test_rows_of_one_side_alone_are_chosen_before_they_are_judged(spark):  # F12, F13
    before = _kept(spark)
    result = queries._match(spark, FOLDER)
    mine = result.not_in_ledger()
    assert not any(name.startswith("codes-") for name in _kept(spark) - before)  # the acquirer's rows need no codes of the ledger's
    for own, status in ((mine, classify.NOT_IN_LEDGER), (result.not_at_acquirer(), classify.NOT_AT_ACQUIRER)):
        all_ = result.detail.where(F.array_contains("statuses", status))
        assert own.columns == all_.columns and own.count() == all_.count() > 0 and own.exceptAll(all_).isEmpty()
        plan = own.select("linha_shift", "linha_rede", "status_conciliacao")._jdf.queryExecution().optimizedPlan().toString()
        assert "array_contains(array_distinct" not in plan

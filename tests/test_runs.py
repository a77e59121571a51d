"""Runs of the test queries: counters, reasons and sections, on inputs that the test tables don't have."""

import gzip
import os

import duckdb
from pyspark.sql import functions as F
from test_matching import side

import __spark_entry__
from ledgerloom.operators import consolidate, keeping, prepare, rollup, schema
from ledgerloom.plans import queries, reports
from ledgerloom.sources import export

FOLDER = "/root/testdata/sf0.001"


def _without_groups(spark, folder):
    """The test tables without the orders that are split over two service orders, which alone give groups."""
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where(F.col(key) % 20 != 6).write.parquet(f"{folder}/{name}.parquet")


def _of_sql(query, folder):
    connection = duckdb.connect()
    for name in ("orders", "lineitem"):
        path = f"{folder}/{name}.parquet"
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return sorted(map(str, connection.sql(__spark_entry__.oracle_sql()[query]).fetchall()))


def test_lines_in_groups_are_null_where_there_is_no_group(spark, tmp_path):  # F1
    _without_groups(spark, tmp_path)
    got = reports.run_counters(spark, str(tmp_path))
    assert got.dtypes == [("indicador", "string"), ("valor", "bigint")]
    rows = [tuple(r) for r in got.collect()]
    assert ("shift_grupos_criados", 0) in rows and ("shift_linhas_agrupadas", None) in rows
    assert sorted(map(str, rows)) == _of_sql("run_counters", tmp_path)
    assert reports._run(spark, str(tmp_path)).counters.where("indicador = 'shift_linhas_agrupadas'").first()["valor"] == 0


def _kept(spark):
    folder = keeping.shared_folder(spark)
    return {name.rsplit("-", 1)[0] for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_counts_of_a_run_write_no_wide_rows(spark):  # F2, F4
    keeping.clear(spark)
    for query in ("run_counters", "run_discard_reasons", "run_counts_per_file"):
        assert sorted(str(tuple(r)) for r in getattr(reports, query)(spark, FOLDER).collect()) == _of_sql(query, FOLDER)
    assert _kept(spark) == {"acquirer", "ledger", "repeated", "counts", "per-file"}
    result = reports._run(spark, FOLDER)
    of = lambda rows: sorted(map(str, rows.collect()))
    assert of(rollup.discard_reasons(result.discards)) == of(result.reasons) and _kept(spark) >= {"discards"}  # whole when asked for
    one = consolidate.counts(result.original_ledger_rows).first()
    assert (one["rows"], one["groups"]) == (result.consolidated.count(), result.consolidated.where("_grouped").count()) and one["groups"] > 0


def test_records_of_several_files_are_moved_once(spark):  # F2, F4
    k = F.col("ord") % 303
    file = F.element_at(F.array(*map(F.lit, ("a.csv", "b.csv", "a.csv", ""))), F.when(k % 7 > 0, F.col("ord") % 4 + 1).otherwise(1).cast("int"))
    own = side(spark, "rede", *({"autorizacao": f"{x % 303:06d}"} for x in range(2000)))
    rows = schema.acquirer(own.withColumns({"rede_arquivo_origem": file, "nsu": F.when(k % 3 > 0, (k % 5).cast("string"))}))
    plans = []
    real = prepare.keep
    try:
        prepare.keep = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
        kept, gone = prepare.deduplicated(rows)
    finally:
        prepare.keep = real
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1
    groups, first = {}, {}
    for r in rows.orderBy("ord").collect():
        groups.setdefault(tuple(r[c] for c in prepare.DEDUP_FIELDS), []).append((r["ord"], r["rede_arquivo_origem"]))
    for own in groups.values():
        files = list(dict.fromkeys(f for _, f in own if f))
        first |= {own[0][0]: " | ".join(files)} if len(files) > 1 else {o: None for o, _ in own}
    assert {r["ord"]: r["rede_arquivos_duplicados"] for r in kept.collect()} == first and gone.count() == 2000 - len(first) > 0


def test_the_report_is_ordered_before_it_is_made(spark, tmp_path):  # F3
    result = queries._match(spark, FOLDER)
    own = result.detail_in_order
    places = [tuple(r) for r in own.select("stage", "emit").collect()]
    assert places == sorted(places) and {s for s, _ in places} == {0, 1, 2}
    assert own.columns == result.detail.columns and own.exceptAll(result.detail).isEmpty() and result.detail.exceptAll(own).isEmpty()
    moved = []
    walk = [export.records(export.sections(result)["detalhado"]())._jdf.queryExecution().optimizedPlan()]
    while walk:
        plan = walk.pop()
        if plan.nodeName() == "Sort":
            moved.append({plan.output().apply(k).name() for k in range(plan.output().size())})
        walk += [plan.children().apply(k) for k in range(plan.children().size())]
    assert len(moved) == 2 and max(map(len, moved)) < 80
    assert not {"motivo", "status_conciliacao", "shift_autorizacao_original", "rede_autorizacao_original"} & set().union(*moved)
    written = export.write_sections(result, str(tmp_path), only=("detalhado",))["detalhado"]
    lines = [line for name in sorted(os.listdir(written)) if name.endswith(".gz") for line in gzip.open(f"{written}/{name}", "rt", encoding="utf-8")]
    rows = [r["value"] for r in export.records(result.detail.orderBy("stage", "emit").drop("stage", "emit", "statuses")).collect()]
    assert [x.rstrip("\n") for x in lines] == rows


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for folder in folders for _, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle_")}


def test_no_shuffle_files_stay_beside_a_kept_table(spark):  # F3
    before = _shuffle_files(spark)
    kept = keeping.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counted")
    assert not _shuffle_files(spark) - before
    assert sorted(r["n"] for r in kept.collect()) == [142] + [143] * 6
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # only while a table is written

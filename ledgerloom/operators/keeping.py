"""Rows that several branches read, as tables in the folder that all executors share."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Only for a local master whose session names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. On a cluster that setting is required: a folder of one machine would lose rows."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: master {master} needs a folder that all executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Wide rows make one generated method too large for the JVM to compile: below this limit Spark splits it. A union's partitions
#: must not stand for a shuffle: its inputs may be read in other partitions than planned. Once a table is written, its shuffles' files go,
#: which would otherwise stay on the executors' disks beside it until the driver collects garbage.
OWN_SETTINGS = {"spark__sql__codegen__hugeMethodLimit": "8000", "spark__sql__unionOutputPartitioning": "false", "spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


@contextmanager
def settings(spark: SparkSession, **own: str) -> Iterator[None]:
    """Session settings (dots written as __) for the jobs inside; afterwards as before."""
    names = {name.replace("__", "."): value for name, value in own.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


_lock = threading.Lock()
_writers: dict[int, tuple[int, ExitStack]] = {}


@contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """OWN_SETTINGS while any thread of the session is inside: the first one in sets them, the last one out takes them back."""
    with _lock:
        n, stack = _writers.get(id(spark), (0, ExitStack()))
        if not n:
            stack.enter_context(settings(spark, **OWN_SETTINGS))
        _writers[id(spark)] = n + 1, stack
    try:
        yield
    finally:
        with _lock:
            n, stack = _writers.pop(id(spark))
            if n > 1:
                _writers[id(spark)] = n - 1, stack
            else:
                stack.close()


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def keep(df: DataFrame, name: str = "kept", **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: made once, and no lost executor takes any of it along.

    It also ends the plan below: each branch then starts from a scan that it prunes and filters for itself, where Catalyst
    would otherwise analyse and compute everything below once for every branch. The table goes when the application ends,
    or with clear(). options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with own_settings(spark):
        df.write.parquet(path, **options)
    system, jvm_path = _file_system(spark, path)
    system.deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def keep_but(df: DataFrame, name: str, fixed: dict[str, Column]) -> DataFrame:
    """keep(), without the columns that fixed gives: constants and copies of others, which are added when the table is read."""
    kept = keep(df.drop(*fixed), name, compression="zstd")  # wide tables
    return kept.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns))


def keep_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """keep(), and aggregates of df's rows that are observed while they are written: they take no job of their own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    kept = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items())), name)
    return kept, seen.get


_made: dict[tuple, object] = {}


def _key(spark: SparkSession, name: str, inputs: list[str]) -> tuple:
    return (spark.sparkContext.applicationId, name, *((path, _version(spark, path)) for path in inputs))


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], T]) -> T:
    """What make() gives, made once for the application from files that are still as they were. It holds frames of kept tables; clear() forgets it."""
    key = _key(spark, name, inputs)
    if key not in _made:
        _made[key] = make()
    return _made[key]  # type: ignore[return-value]


def is_made(spark: SparkSession, name: str, inputs: list[str]) -> bool:
    """Whether once() would give what it has already."""
    return _key(spark, name, inputs) in _made


def _version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: of the file itself, or of those in its folder."""
    system, jvm_path = _file_system(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(jvm_path)))


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has kept. Frames made from them can't be read any more."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
    system, jvm_path = _file_system(spark, shared_folder(spark))
    system.delete(jvm_path, True)

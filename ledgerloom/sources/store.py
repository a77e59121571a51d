"""Units and finished reconciliations as Parquet tables in one folder.

Every table is a log: a change appends a row of the next version, a deletion one that is marked; the current state is the
last version of each id. Nothing is rewritten, so a job that fails leaves the state as it was. One writer at a time.
Reconciliations are partitioned by unit and day, so a filtered list reads only those folders.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import ConflictError, NotFoundError
from ledgerloom.operators import history

UNITS = "id bigint, codigo string, nome string, estabelecimento string, empresa_shift string, ativa boolean, criado_em string, atualizado_em string"
RUNS = "id string, unidade_id bigint, data_conciliacao date, status string, resumo_json string, criado_em string"
FILES = "id bigint, conciliacao_id string, origem string, categoria string, nome_original string, caminho_arquivo string, quantidade_linhas bigint, criado_em string"
LOG = ", _version bigint, _gone boolean"
CATEGORIES = ("REDE", "SHIFT")
DONE = "CONCLUIDA"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _stripped(text: str | None) -> str | None:
    return text.strip() if text else None


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- the logs ---

    def _log(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + LOG).parquet(f"{self.folder}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema + LOG)

    def _current(self, table: str, schema: str) -> DataFrame:
        log = self._log(table, schema)
        last = log.groupBy("id").agg(F.max_by(F.struct("*"), "_version").alias("x")).select("x.*")
        return last.where("not _gone").drop("_version", "_gone")

    def _append(self, table: str, schema: str, rows: list[dict], gone: bool = False) -> None:
        version = (self._log(table, schema).agg(F.max("_version")).first()[0] or 0) + 1
        df = self.spark.createDataFrame([(*(r[c.split()[0]] for c in schema.split(", ")), version, gone) for r in rows], schema + LOG).coalesce(1)
        writer = df.write.mode("append")
        (writer.partitionBy("unidade_id", "data_conciliacao") if table == "conciliacoes" else writer).parquet(f"{self.folder}/{table}")

    def _next_id(self, table: str, schema: str) -> int:
        return (self._log(table, schema).agg(F.max("id")).first()[0] or 0) + 1

    # --- units ---

    def units(self, active_only: bool = False) -> DataFrame:
        """Units by name, without regard to case."""
        own = self._current("unidades", UNITS)
        return (own.where("ativa") if active_only else own).orderBy(F.lower("nome"))

    def unit(self, unit_id: int) -> dict | None:
        row = self._current("unidades", UNITS).where(F.col("id") == unit_id).first()
        return row.asDict() if row else None

    def _checked(self, code: str, name: str, own_id: int | None = None) -> tuple[str, str]:
        code, name = code.strip(), name.strip()
        if not code or not name:
            raise ConflictError("Código e nome são obrigatórios.")  # fixed value: the message
        same = self._current("unidades", UNITS).where(F.lower("codigo") == code.lower())
        if not (same if own_id is None else same.where(F.col("id") != own_id)).isEmpty():
            raise ConflictError("Já existe uma unidade com esse código.")  # fixed value: the message
        return code, name

    def create_unit(self, code: str, name: str, establishment: str | None = None, company: str | None = None) -> int:
        code, name = self._checked(code, name)
        unit_id, now = self._next_id("unidades", UNITS), _now()
        self._append("unidades", UNITS, [{"id": unit_id, "codigo": code, "nome": name, "estabelecimento": _stripped(establishment), "empresa_shift": _stripped(company), "ativa": True, "criado_em": now, "atualizado_em": now}])
        return unit_id

    def update_unit(self, unit_id: int, code: str, name: str, establishment: str | None, active: bool, company: str | None = None) -> None:
        code, name = self._checked(code, name, unit_id)
        before = self.unit(unit_id)
        if before is None:
            raise NotFoundError("Unidade não encontrada.")  # fixed value: the message
        self._append("unidades", UNITS, [before | {"codigo": code, "nome": name, "estabelecimento": _stripped(establishment), "empresa_shift": _stripped(company), "ativa": bool(active), "atualizado_em": _now()}])

    def delete_unit(self, unit_id: int) -> None:
        """Only a unit without reconciliations goes."""
        if not self._current("conciliacoes", RUNS).where(F.col("unidade_id") == unit_id).isEmpty():
            raise ConflictError("A unidade possui conciliações. Desative-a para preservar o histórico.")  # fixed value: the message
        before = self.unit(unit_id)
        if before is None:
            raise NotFoundError("Unidade não encontrada.")  # fixed value: the message
        self._append("unidades", UNITS, [before], gone=True)

    # --- reconciliations ---

    def save(self, run_id: str, unit_id: int, day: str, summary: dict, files: list[dict]) -> None:
        """A finished run and its files (origem, categoria, nome_original, caminho_arquivo, quantidade_linhas)."""
        if self.unit(unit_id) is None:
            raise NotFoundError("Unidade não encontrada.")  # fixed value: the message
        if not self._current("conciliacoes", RUNS).where(F.col("id") == run_id).isEmpty():
            raise ConflictError(f"A conciliação {run_id} já existe.")
        if len({f["origem"] for f in files}) < len(files) or any(f["categoria"] not in CATEGORIES for f in files):
            raise ConflictError("Cada arquivo precisa de uma origem própria e da categoria REDE ou SHIFT.")  # fixed value: the message
        now = _now()
        if files:  # before the run itself: files of a run that doesn't exist are in no list
            first = self._next_id("importacoes", FILES)
            self._append("importacoes", FILES, [f | {"id": first + k, "conciliacao_id": run_id, "criado_em": now} for k, f in enumerate(files)])
        text = json.dumps(summary, ensure_ascii=False, default=float)
        self._append("conciliacoes", RUNS, [{"id": run_id, "unidade_id": unit_id, "data_conciliacao": datetime.fromisoformat(day).date(), "status": DONE, "resumo_json": text, "criado_em": now}])

    def runs(self, unit_id: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """Reconciliations with their unit's name, the newest first."""
        return history.listed(self._current("conciliacoes", RUNS), self._current("unidades", UNITS), unit_id, start, end)

    def run(self, run_id: str) -> dict | None:
        """A reconciliation with its unit, its summary as a dictionary, and its files by origin."""
        own = self._current("conciliacoes", RUNS).where(F.col("id") == run_id)
        unit = self._current("unidades", UNITS).select(F.col("id").alias("unidade_id"), F.col("codigo").alias("unidade_codigo"), F.col("nome").alias("unidade_nome"))
        row = own.join(unit, "unidade_id").first()
        if row is None:
            return None
        files = {r["origem"]: r.asDict() for r in self._current("importacoes", FILES).where(F.col("conciliacao_id") == run_id).collect()}
        found = row.asDict()
        return found | {"resumo": json.loads(found.pop("resumo_json")), "arquivos": files}

    def delete_run(self, run_id: str) -> list[str]:
        """Removes a reconciliation with its files; returns the paths of those."""
        row = self._current("conciliacoes", RUNS).where(F.col("id") == run_id).first()
        if row is None:
            raise NotFoundError("Conciliação não encontrada.")  # fixed value: the message
        files = [r.asDict() for r in self._current("importacoes", FILES).where(F.col("conciliacao_id") == run_id).collect()]
        self._append("conciliacoes", RUNS, [row.asDict()], gone=True)
        if files:
            self._append("importacoes", FILES, files, gone=True)
        return [f["caminho_arquivo"] for f in files]

"""CSV files cut into byte ranges anywhere: the same records as a reader of whole files gives."""

import csv
import io
import random

import pytest

from ledgerloom.sources import delimited, records, uploads
from ledgerloom.sources.uploads import Upload


@pytest.fixture
def ranges(spark):
    """Byte ranges of so many bytes; afterwards as before."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def set_(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")

    yield set_
    for name in names:
        spark.conf.unset(name)


def whole(text, sep):
    """The rows below the header, by a reader of whole texts."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, strict=False) if r and not (len(r) == 1 and not r[0].strip())]
    null = lambda x: None if x in records.NULLS else x
    own = [[null(x) for x in r] for r in rows[1:] if len(r) <= len(rows[0])]
    return [r + [None] * (len(rows[0]) - len(r)) for r in own if any(x is not None for x in r)]


def some_text(rng, sep, n):
    def cell():
        kind = rng.random()
        if kind < 0.4:
            return str(rng.randint(0, 999))
        if kind < 0.6:
            return rng.choice(["", "NA", "é", "x y", "-", "ção"])
        inner = "".join(rng.choice(["a", sep, '""', "\n", "é", "1", "\n\n"]) for _ in range(rng.randint(0, 6)))
        return f'"{inner}"'

    rows = [sep.join(cell() for _ in range(3 + (rng.random() < 0.05) - (rng.random() < 0.05))) for _ in range(n)]
    return sep.join("kvw") + "\n" + "\n".join(rows) + rng.choice(["", "\n", "\n\n"])


def test_random_files_in_small_ranges(spark, tmp_path, ranges):
    rng = random.Random(5)
    texts = {}
    for k in range(24):
        sep = rng.choice(records.SEPARATORS)
        own = some_text(rng, sep, rng.randint(0, 25))
        texts[k] = (own, sep)
        encoding = rng.choice(["utf-8", "utf-8-sig", "latin-1"])
        (tmp_path / f"f {k}.csv").write_bytes(own.encode(encoding))
    ranges(37)
    found = records.read(spark, [str(tmp_path / f"f {k}.csv") for k in texts])
    rows = sorted((r["file"], r["n"], list(r["cells"])) for r in found.rows.collect())
    for k, (text, _) in texts.items():
        sample = "\n".join(text.split("\n")[:8])
        expected = whole(text, max(records.SEPARATORS, key=sample.count))
        got = [c + [None] * (len(expected[0]) - len(c)) if expected else c for f, _, c in rows if f == k]
        assert got == expected, k
        assert [n for f, n, _ in rows if f == k] == list(range(len(expected)))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    """Quoted line ends all along a file of 60,000 records: numbers are dense, and byte ranges are many."""
    path = str(tmp_path / "large.csv")
    with open(path, "w") as f:
        f.write("a;b\r\n")
        for k in range(60_000):
            f.write(f'{k};"x\ny;{k}"\r\n' if k % 7 == 0 else f"{k};z\r\n")
    ranges(1 << 16)
    assert records.lines(spark, [path]).select("block").distinct().count() >= 10
    rows = delimited.read(spark, path)
    assert rows.where("ord = cast(a as bigint) and _line = ord").count() == rows.count() == 60_000
    assert rows.where("b = concat('x\ny;', a)").count() == len(range(0, 60_000, 7))


HEAD = "data do recebimento;valor bruto;nsu;numero da autorizacao\n"
REPORT = "Relatório\n\nEmpresa;Espécie;{form}Valor bruto;Nro autorização cartão;Descrição\n"


def jobs(spark, work):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return out, n


def test_many_files_are_one_scan(spark, tmp_path):
    for k in range(200):
        text = HEAD if k % 2 else "nsu;extra;autorizacao;valor\n"
        (tmp_path / f"rede {k % 28 + 1:02d}.11.2025 {k}.csv").write_text(text + "".join(f"01/11/2025;{i},50;{i};{k}{i}\n" if k % 2 else f"{i};;{k}{i};{i},50\n" for i in range(1, 4)))
    own = [Upload(str(p), f"REDE_{k:03d}", p.name) for k, p in enumerate(sorted(tmp_path.iterdir()))]
    few, of_few = jobs(spark, lambda: uploads.acquirer(spark, own[:5]).collect())
    all_, of_all = jobs(spark, lambda: uploads.acquirer(spark, own).collect())
    print(f"jobs: {of_few} for 5 files, {of_all} for 200")
    assert len(few) == 15 and len(all_) == 600 and of_all <= of_few + 2
    for r in all_:
        name = next(u.name for u in own if u.origin == r["rede_origem_id"])
        assert r["rede_arquivo_origem"] == name and r["rede_data_relatorio"].day == int(name[5:7]) and r["_row"] == int(r["nsu"]) + 1 and float(r["valor_bruto"]) == int(r["nsu"]) + 0.5
    assert len({r["ord"] for r in all_}) == 600


def test_reports_among_exports(spark, tmp_path, ranges):
    form = "Forma de pagamento/cobrança;"
    (tmp_path / "a.csv").write_text(REPORT.format(form=form) + 'X;Cartão;REDE 2X VISA;10,00;5040;"uma\n\nduas; OS: 7"\n\nX;PIX;PIX ITAU;9,00;1;\n;;;;;\nEmitido por: Y\nX;Cartão;REDE;1;1;\n', encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text(REPORT.format(form="") + "Y;cartão;7,00;123;\n", encoding="latin-1")
    (tmp_path / "c.csv").write_text("nsu;autorizacao;valor bruto\n1;77;3,00\n")
    (tmp_path / "d.csv").write_text("\n \n")
    own = [Upload(str(tmp_path / f"{x}.csv"), f"SHIFT_{x}", x) for x in "abcd"]
    for size in (1 << 27, 23):
        ranges(size)
        found = uploads.ledger(spark, own)
        rows = {r["origem_id"]: r for r in found.rows.collect()}
        assert found.reports and sorted(rows) == ["SHIFT_a", "SHIFT_b", "SHIFT_c"] and found.rows.count() == 3
        assert (rows["SHIFT_a"]["_row"], rows["SHIFT_a"]["os_shift"], rows["SHIFT_a"]["numero_parcelas"]) == (4, "7", 2) and rows["SHIFT_a"]["_alertas_normalizacao"] == []
        assert (rows["SHIFT_b"]["_row"], rows["SHIFT_b"]["empresa"]) == (4, "Y") and "FORMA_PAGAMENTO_AUSENTE" in rows["SHIFT_b"]["_alertas_normalizacao"]
        assert sorted((r["motivo_descarte"], r["numero_linha_original"]) for r in found.discards.collect()) == [("FORMA_PAGAMENTO_NAO_CARTAO", "5"), ("FORMA_PAGAMENTO_NAO_CARTAO", "6")]
    (tmp_path / "e.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError, match="cabeçalho"):
        delimited.read_report(spark, str(tmp_path / "e.csv"))
    (tmp_path / "f.csv").write_text("Empresa;Valor bruto;Nro autorização cartão\nX;1;2\n")
    with pytest.raises(ValueError, match="Espécie"):
        delimited.read_report(spark, str(tmp_path / "f.csv"))

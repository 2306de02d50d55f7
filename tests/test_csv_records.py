"""CSV records over several lines, at any split of the file."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tablight.sources import files, records


@pytest.fixture(params=[1 << 27, 400, 37])
def split(spark, request):
    """The files' bytes per split."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def random_rows(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    parts = ["a", "bc", '"', '""', "\n", "\n\n", ",", ' "x" ', "é", "日", "'", "\\", "5\" pipe", "end\n"]
    return [[str(i), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), "t" + rng.choice(parts)] for i in range(n)]


def written(rows, path, sep=",", end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end).writerows([["id", "text", "more"], *rows])
    path.write_bytes(out.getvalue().encode())
    return out.getvalue()


def read_back(df):
    return sorted(tuple(r) for r in df.select("id", "text", "more").collect())


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n")])
def test_records_over_lines(spark, tmp_path, split, seed, end):
    rows = random_rows(seed, 240)
    text = written(rows, tmp_path / "a.csv", end=end)
    assert records.spans_lines(spark, str(tmp_path / "a.csv"))
    got = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert split > 37 or len(text) // split >= 64
    assert read_back(got) == sorted((int(i), t or None, m) for i, t, m in rows)
    skipped = files.skipped_csv(spark, str(tmp_path / "a.csv")).first()
    assert (skipped["kept"], skipped["skipped"]) == (240, 0)


def test_records_equal_duckdb(spark, tmp_path, split):
    duckdb = pytest.importorskip("duckdb")
    rows = [[str(i), f'line {i}\nsaid "so", twice\n', "x" * (i % 7) + "y"] for i in range(90)]
    written(rows, tmp_path / "b.csv")
    want = duckdb.sql(f"SELECT id, text, more FROM read_csv('{tmp_path}/b.csv', header = true, delim = ',', quote = '\"', "
                      "escape = '\"', all_varchar = true, new_line = '\\n')").fetchall()
    got = files.read_csv(spark, str(tmp_path / "b.csv")).withColumn("id", F.col("id").cast("string"))
    assert read_back(got) == sorted(want)


def test_long_and_short_records(spark, tmp_path, split):
    (tmp_path / "c.csv").write_text('id,text,more\n1,"a\nb",x\n2,b\n\n3,c,y,z\n4,"d,""e""\n",z\n')
    got = files.read_csv(spark, str(tmp_path / "c.csv"))
    assert read_back(got.fillna("-")) == [(1, "a\nb", "x"), (2, "b", "-"), (4, 'd,"e"\n', "z")]
    assert tuple(files.skipped_csv(spark, str(tmp_path / "c.csv")).first()) == (3, 1)
    (tmp_path / "d.csv").write_text('id,text,more\n1,"a ""b""",x\n2,b\n\n3,c,y,z\n')
    flat = files.read_csv(spark, str(tmp_path / "d.csv"))
    assert read_back(flat.fillna("-")) == [(1, 'a "b"', "x"), (2, "b", "-")]
    assert flat.count() == 2
    assert tuple(files.skipped_csv(spark, str(tmp_path / "d.csv")).first()) == (2, 1)


def test_field_that_never_closes(spark, tmp_path, split):
    (tmp_path / "e.csv").write_text('id,text,more\n' + "".join(f"{i},t{i},m\n" for i in range(40))
                                    + '40,"open,m\n' + "".join(f"{i},t{i},m\n" for i in range(41, 60)))
    got = files.read_csv(spark, str(tmp_path / "e.csv"))
    assert got.count() == 60
    assert got.where("id = 40").first()["text"] == '"open'


def test_several_files_and_latin1(spark, tmp_path, split):
    (tmp_path / "in").mkdir()
    for k in range(3):
        rows = [[str(100 * k + i), f"Müller\n{i}", "m"] for i in range(10)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator="\n").writerows([["id", "text", "more"], *rows])
        (tmp_path / "in" / f"{k}.csv").write_bytes(out.getvalue().encode("latin-1"))
    got = files.read_csv(spark, str(tmp_path / "in"))
    assert read_back(got) == sorted((100 * k + i, f"Müller\n{i}", "m") for k in range(3) for i in range(10))


def test_types_of_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c,d,e,f,g\n1,9999999999,1.5,2024-01-02,2024-01-02 03:04:05,true,x\n"
                                    "-2,1,2,2024-02-03,2024-01-02,FALSE,1\n,,,,,,\n")
    got = files.read_csv(spark, str(tmp_path / "f.csv"))
    assert [t for _, t in got.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string"]
    (tmp_path / "g.csv").write_text((tmp_path / "f.csv").read_text().replace(",x\n", ',"x\ny"\n'))
    assert files.read_csv(spark, str(tmp_path / "g.csv")).dtypes == got.dtypes


def test_line_state():
    rng = random.Random(4)
    for _ in range(3000):
        line = "".join(rng.choice('a,"') for _ in range(rng.randint(0, 8)))
        if not line:
            continue
        probe = "\x01"
        fields = next(csv.reader([line + "\n", probe + '"']))
        assert records.ends_open(line.encode(), False, b",") == (probe in fields[-1])
        fields = next(csv.reader(['"\n', line + "\n", probe + '"']))
        assert records.ends_open(line.encode(), True, b",") == (probe in fields[-1])

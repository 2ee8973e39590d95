"""CSV with line breaks in quotes, in many ranges, against Python's reader."""

import csv
import io
import random

import pytest

from brightloom.errors import ParseError
from brightloom.sources import files, quoted


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "150")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(rng):
    kind = rng.random()
    if kind < 0.25:
        return ""
    if kind < 0.6:
        return "".join(rng.choice("abc é") for _ in range(rng.randint(1, 9)))
    some = "".join(rng.choice(['"', ",", "\n", "\r\n", "x", "y ", "é"]) for _ in range(rng.randint(0, rng.choice([4, 20, 200]))))
    return '"' + some.replace('"', '""') + '"'


@pytest.mark.parametrize(("seed", "ending", "header"), [(1, "\n", True), (2, "\r\n", True), (3, "\n", False), (4, "\r\n", False)])
def test_many_ranges_of_a_file(spark, tmp_path, small_ranges, monkeypatch, seed, ending, header):
    monkeypatch.setattr(quoted, "SHORT", 90)
    monkeypatch.setattr(quoted, "AT_ONCE", 3)
    monkeypatch.setattr(quoted, "FEW", seed * 5)
    rng = random.Random(seed)
    want = []
    for f in range(2):
        records = [[field(rng) for _ in range(3)] for _ in range(60)]
        records = [r for r in records if "".join(r)]
        if header:
            records.insert(0, ["p", '"q\n""r"""' if seed == 1 else "q", "r"])
        text = ending.join(",".join(r) + (ending if rng.random() < 0.1 else "") for r in records) + (ending if f else "")
        (tmp_path / f"{f}.csv").write_bytes(text.encode())
        want += [tuple(x or None for x in r) for r in csv.reader(io.StringIO(text, newline="")) if r][header:]
    df = files.read_csv(spark, str(tmp_path), header=header, infer=False, null_values=[""])
    rows = quoted.lines(spark, str(tmp_path))
    assert rows.select("path", "start").distinct().count() > 20
    # blanks alone are null by the same rule in both
    clean = lambda r: tuple(None if x is None or not x.strip(" ") else x for x in r)
    assert sorted(map(repr, (clean(r) for r in df.collect()))) == sorted(map(repr, map(clean, want)))
    assert df.columns == (["p", 'q\n"r"', "r"] if seed == 1 else ["p", "q", "r"] if header else ["col0", "col1", "col2"])


def test_files_without_quoted_breaks_are_left_to_spark(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(200)))
    assert quoted.read(spark, str(tmp_path), 2, ",", True, False) is None
    df = files.read_csv(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 5 and df.count() == 200 and df.dtypes == [("a", "bigint"), ("b", "string")]


def test_one_record_over_many_ranges_and_strict(spark, tmp_path, small_ranges):
    long = "\n".join(f"line {i}" for i in range(300))
    (tmp_path / "a.csv").write_text(f'k;v\n1;"{long}"\n2;z\n3;"a\nb";c\n4\n')
    got = {r.k: r.v for r in files.read_csv(spark, str(tmp_path), delimiter=";").collect()}
    assert got == {1: long, 2: "z", 3: "a\nb", 4: None}
    with pytest.raises(Exception, match="fields") as e:
        files.read_csv(spark, str(tmp_path), delimiter=";", strict=True).collect()
    assert ParseError.__name__ in str(e.value)


def test_header_alone_and_open_end(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text('"a\nb",c\n')
    df = files.read_csv(spark, str(tmp_path))
    assert df.columns == ["a\nb", "c"] and df.count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_text('a,c\n1,"never\nclosed\n')
    assert [r.c for r in files.read_csv(spark, str(tmp_path / "b")).collect()] == ["never\nclosed"]

import random

import pytest

from grantrisk.sources import quoted, text


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("seed", range(8))
def test_many_tasks_read_what_one_reads(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    fields = ["a", "bb", "", '"x\ny"', '"p;q"', '""', '"i ""k"" \n\n;"', "12,5", " ", "é"]
    if seed % 2:  # quotes where they don't belong, too
        fields += ['a"b', 'c"', ' "d"']
    broken = fields + ['"a"b', '"x\ny" z'] * (seed % 2)
    body = "".join(f"{rng.choice(broken)};{rng.choice(broken)};{rng.choice(fields)}\n" for _ in range(50)) + '"end";"of\nfile";1\n'
    end = "\r\n" if seed % 4 == 2 else "\n"
    path = str(tmp_path / "f.csv")
    with open(path, "w", newline="") as f:
        f.write(("h1;h2;h3\n" + body).replace("\n", end))
    expected = spark.read.options(**text.CSV_OPTIONS).option("multiLine", "true").csv(path)
    got = text.read_text_table(spark, path)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10
    assert got.columns == ["h1", "h2", "h3"] and rows(got) == rows(expected)


def test_a_record_over_many_splits_and_several_files(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}; with a ""quote""" for i in range(60)).replace('"', '""')
    for name in "ab":
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write(f'h1;h2\n1;"{long}"\n2;x\n3;"{long}"\n')
    with open(tmp_path / "c.csv", "w") as f:
        f.write("h1;h2\n")
    got = text.read_text_table(spark, str(tmp_path))
    assert sorted((r.h1, len(r.h2)) for r in got.collect()) == sorted(
        [("1", len(long.replace('""', '"'))), ("2", 1), ("3", len(long.replace('""', '"')))] * 2)
    assert rows(got) == rows(spark.read.options(**text.CSV_OPTIONS).option("multiLine", "true").csv(str(tmp_path)))


def test_states_are_those_of_a_scan(spark):
    rng = random.Random(3)
    table, expected = [], {}
    for file in range(5):
        state = False
        for start in range(0, 30):
            out, into = rng.choice([(False, False), (True, True), (False, True), (False, True), (True, False)])
            table.append((file, start, out, into))
            expected[file, start] = state
            state = into if state else out
    df = spark.createDataFrame(table, "file long, start long, after_out boolean, after_in boolean").repartition(7)
    assert {(r.file, r.start): r.inside for r in quoted.split_states(df).collect()} == expected


def test_only_quotes_at_the_start_of_a_field_open_it():
    assert quoted.ends_inside('a;"b', False) and not quoted.ends_inside('a"b;c', False)
    assert not quoted.ends_inside('b";c', True) and quoted.ends_inside('b"";c', True)
    assert quoted.ends_inside('b";"c', True) and not quoted.ends_inside('"a"b"c;d', False)
    assert quoted.ends_inside("", True) and not quoted.ends_inside("", False)


def test_small_files_are_read_whole(spark, tmp_path):
    (tmp_path / "f.csv").write_text('h1;h2\n1;"a\nb"\n')
    assert [tuple(r) for r in text.read_text_table(spark, str(tmp_path)).collect()] == [("1", "a\nb")]
    assert "MapInArrow" in text.read_text_table(spark, str(tmp_path), split_bytes=3)._jdf.queryExecution().toString()


@pytest.mark.parametrize("body,plain", [("a;b\n1;2\n;x y\n", True), ("a;b\n1;\"2\"\n", False), ("a;b\r\n1;2\r\n", False), ("a;b\n  \n1;2\n", False)])
def test_lines_without_quotes_need_no_python(spark, tmp_path, body, plain):
    path = str(tmp_path / "f.csv")
    with open(path, "w", newline="") as f:
        f.write(body)
    got = text.read_text_table(spark, path, split_bytes=0)
    assert ("MapInArrow" not in got._jdf.queryExecution().toString()) == plain
    expected = spark.read.options(**text.CSV_OPTIONS).option("multiLine", "true").csv(path)
    assert got.columns == expected.columns and rows(got) == rows(expected)


def test_quotes_are_looked_for_once(spark, tmp_path, monkeypatch):
    path, calls, one = str(tmp_path / "f.csv"), [], quoted.split_functions
    with open(path, "w") as f:
        f.write('a;b\n"x\ny";2\n')
    monkeypatch.setattr(quoted, "split_functions", lambda *a: calls.append(cut := one(*a)) or cut)
    got = quoted.read_text_table(spark, path, text.CSV_OPTIONS)
    assert [tuple(r) for r in got.collect()] == [("x\ny", "2")] and len(calls) == 1
    assert got._jdf.queryExecution().logical().toString().count("MapInArrow") == 1  # the records; the splits' states are a table

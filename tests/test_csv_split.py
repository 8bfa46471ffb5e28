import random

import pytest

from bazarlens.sources import csv_split, tables


def reader_rows(spark, path):
    """What Spark's own multi-line reader makes of the files, one task each."""
    raw = spark.read.options(**csv_split.OPTIONS).option("header", True).csv(str(path))
    return sorted(map(tuple, raw.collect()), key=repr)


def split_rows(spark, path):
    return sorted(map(tuple, csv_split.read_split_csv(spark, str(path)).collect()), key=repr)


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so one file is read by many tasks."""
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def field(text):
    return '"' + text.replace('"', '""') + '"'


def made_lines(seed, n=300, end="\n"):
    rng = random.Random(seed)
    pieces = ["word", ",", " ", '"', "\n", "\n\n", "é", '""', "a\nb\nc", "'"]
    rows = ["id,plain,text"]
    for i in range(n):
        text = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 8, 60])))
        rows.append(f"{i},{rng.choice(['x', '', 'y z'])},{field(text) if text else ''}")
    return end.join(rows) + end


@pytest.mark.parametrize("seed", [1, 2])
def test_one_file_by_many_tasks(spark, tmp_path, small_ranges, seed):
    path = tmp_path / "reviews.csv"
    path.write_text(made_lines(seed), encoding="utf-8")
    lines = csv_split.numbered_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() > 10
    assert split_rows(spark, path) == reader_rows(spark, path)


def test_record_over_several_ranges_and_no_last_line_end(spark, tmp_path, small_ranges):
    path = tmp_path / "long.csv"
    long = "\n".join(f"line {i}, with ""quotes""" for i in range(200))
    path.write_text(f"a,b\n1,{field(long)}\n2,{field('end')}\n3,{field(long)}", encoding="utf-8")
    rows = split_rows(spark, path)
    assert rows == reader_rows(spark, path) and sorted(r[1] for r in rows) == sorted([long, "end", long])


def test_mark_carriage_returns_empty_lines_and_several_files(spark, tmp_path, small_ranges):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"\xef\xbb\xbf" + 'id,text\r\n1,"x\r\ny"\r\n\r\n2,plain\r\n3,""\r\n4\r\n'.encode())
    (folder / "b.csv").write_text("id,text\n" + "".join(f'{i},"{i}\n,{i}"\n' for i in range(5, 90)))
    (folder / "c.csv").write_text("id,text\n")
    rows = split_rows(spark, folder)
    assert ("1", "x\ny") in rows and ("2", "plain") in rows and ("7", "7\n,7") in rows
    assert rows == reader_rows(spark, folder)


def test_quotes_that_do_not_pair_up_go_to_the_reader(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('id,text\n1,5" wide\n2,b\n')
    assert csv_split.read_split_csv(spark, str(path)) is None
    assert sorted(map(tuple, tables.read_csv(spark, str(path)).collect())) == reader_rows(spark, path)


def test_payments_and_sellers(spark, tmp_path):
    """Loaded for profiles only; their columns are text."""
    (tmp_path / "order_payments_dataset.csv").write_text("order_id,payment_value\no1,10.5\n")
    (tmp_path / "sellers_dataset.csv").write_text("seller_id,seller_city\ns1,rio\ns2,santos\n")
    frames = tables.load_profile_only(spark, str(tmp_path))
    assert {k: (f.count(), f.columns) for k, f in frames.items()} == {
        "payments": (1, ["order_id", "payment_value"]),
        "sellers": (2, ["seller_id", "seller_city"]),
    }

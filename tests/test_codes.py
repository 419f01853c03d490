"""Code lists against Python's csv, in ranges of a few bytes."""

import csv
import io
import random

from assayflow.sources import codes


def want(texts):
    rows, names = [], None
    for text in texts:
        reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
        head = next(reader)
        names = names or head
        rows += [tuple((r + [""] * len(names))[: len(names)]) for r in reader if r]
    return names, rows


def test_cells_with_line_ends_over_ranges(spark, tmp_path):
    """One file is many tasks, whatever is cut: cells over several ranges, doubled quotes, quotes within cells, empty lines."""
    rng = random.Random(3)
    cells = ["", "a", 'say ""x""', "x,y", "line\nend", "\n\n", 'q"', "é", " s ", '""', "1", "long " * 30, "\n,\n"]
    quoted = lambda c: f'"{c}"' if any(x in c for x in ',\n"') and c != 'q"' or rng.random() < 0.3 and c != 'q"' else c
    line = lambda: ",".join(quoted(rng.choice(cells)) for _ in range(3))
    texts = []
    for k, name in enumerate(("a.csv", "b.csv", "c.csv")):
        body = "".join(line() + ("\r\n" if rng.random() < 0.2 else "\n") + ("\n" if rng.random() < 0.1 else "") for _ in range((150, 0, 40)[k]))
        texts.append(("﻿" if k == 0 else "") + '"A",B,"C\nD"\n' + body)
        (tmp_path / name).write_bytes(texts[-1].encode())
    names, rows = want(texts)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        got = codes.read_lab_codes(spark, str(tmp_path)).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got[0].asDict().keys() == {*names, "row_no"}
    assert [tuple(r[n] for n in names) for r in got] == rows
    assert [r["row_no"] for r in got] == list(range(len(rows)))


def test_short_rows_and_nothing(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n1\n\n2,3,4\n")
    assert [tuple(r) for r in codes.read_lab_codes(spark, str(tmp_path / "x.csv")).orderBy("row_no").collect()] == [("1", "", 0), ("2", "3", 1)]
    (tmp_path / "empty.csv").write_text("")
    assert codes.read_lab_codes(spark, str(tmp_path / "empty.csv")).count() == 0

"""Uploads read split by split: the same records wherever the splits fall."""

import csv
import io

import numpy as np
import pytest

from snapforge.sources import files as S


@pytest.mark.parametrize("size", [256, 3000])
def test_records_over_split_ends(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    parts = ["a", ";", '"', "\n", "\n\n", "é", " ", '""', "x;y", "\n;\n", "long text " * 3]
    want = [["k", "t", "u"]]
    for i in range(300):
        want.append([str(i), "".join(rng.choice(parts, rng.integers(0, 12 if i % 40 else 400))), "end"])
    text = io.StringIO()
    csv.writer(text, delimiter=";", lineterminator="\n").writerows(want)
    raw = text.getvalue()
    assert list(csv.reader(io.StringIO(raw, newline=""), delimiter=";")) == want
    path = tmp_path / "u.csv"
    path.write_bytes(raw.replace('"end"\n', "end\n").encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 2
        rows = S.read_upload(spark, str(path), tokens=[]).orderBy("__ROW").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["__ROW"] for r in rows] == list(range(1, 301))
    assert [[r["k"], r["t"] or "", r["u"]] for r in rows] == want[1:]


def test_stray_quotes_line_ends_and_empty_lines(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_bytes(b'a;b\r\n5" disk;x\r\n\r\n"q\r\nr";y\nonly\n"";""\n;z')
    rows = S.read_upload(spark, str(path), tokens=[]).orderBy("__ROW").collect()
    assert [(r["a"], r["b"]) for r in rows] == [('5" disk', "x"), ("q\r\nr", "y"), ("only", None), (None, None), (None, "z")]
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.csv").write_text(f'c\n"{n}\n1"\n{n}2\n')
    rows = S.read_upload(spark, str(tmp_path / "two")).orderBy("__ROW").collect()
    assert [r["c"] for r in rows] == ["a\n1", "a2", "b\n1", "b2"]

"""Quoted records over line and split ends, against a reader that goes through a file byte by byte."""

import os
import random

import pytest

from ledgerlake.sources import quoting
from ledgerlake.sources import statements as SRC


def brute(lines):
    """Records of one file's lines; lines from a last quote that never closes stay on their own."""
    out, open_ = [], []
    for x in lines:
        open_.append(x)
        if sum(y.count('"') for y in open_) % 2 == 0:
            out.append("\n".join(open_))
            open_ = []
    return out + open_


def random_file(rnd, n):
    def cell():
        body = "".join(rnd.choice(["a", "7", ",", "\n", '""', " "]) for _ in range(rnd.randrange(0, 8)))
        return f'"{body}"' if rnd.random() < 0.4 else "x" * rnd.randrange(1, 9)
    text = "\n".join(",".join(cell() for _ in range(3)) for _ in range(n))
    return text + ('\nbad,"never closed,1\nnext,1,2\nlast,3,4' if rnd.random() < 0.5 else "")


@pytest.mark.parametrize("split", ["64b", "1k", "10m"])
def test_records_over_splits(spark, tmpdir_path, split):
    rnd = random.Random(3)
    want = {}
    for i in range(6):
        text = random_file(rnd, rnd.choice([1, 5, 200]))
        with open(os.path.join(tmpdir_path, f"f{i}.csv"), "w", newline="") as f:
            f.write(text + "\n")
        want[f"f{i}.csv"] = sorted(brute(text.split("\n")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = SRC.read_lines(spark, tmpdir_path)
        rows = quoting.join_records(lines.withColumn("extra", lines.line)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r["source_file"]), []).append(r["line"])
        assert r["line"].split("\n")[0] == r["extra"]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_states_are_one_row_per_split(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "a.csv"), "w") as f:
        f.write("".join(f'1,"two\n{i}",3\n' for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = quoting.numbered(SRC.read_lines(spark, tmpdir_path))
        splits = lines.select("at.block").distinct().count()
        states = quoting.split_states(lines).orderBy("block").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(states) == splits > 3 and {r["enter"] for r in states} == {0, 1}
    assert all(r["open_from"] is None for r in states) and states[0]["carried"] is None


def test_one_large_file_reads_whole(spark, tmpdir_path):
    n = 3000
    with open(os.path.join(tmpdir_path, "big.csv"), "w") as f:
        f.write("date,description,amount\n" + "".join(f'2024-01-{i % 28 + 1:02d},"row {i}\n- {i}",{i}.5\n' for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = SRC.read_records(spark, tmpdir_path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(int(float(r["fields"]["amount"])) for r in rows) == list(range(n))
    assert all(r["_corrupt_record"] is None and r["fields"]["description"] == "row {0}\n- {0}".format(r["fields"]["amount"][:-2]) for r in rows)

"""The strategy cascade on files that need each strategy, and column types and samples against pandas."""

import io
import os

import pandas as pd

from ledgerlake.sources import cascade

FILES = {
    "standard.csv": "date,description,amount\n2024-01-01,Tea,4.5\n2024-01-02,Toast\n,,\n",
    "semicolon.csv": "date;description;amount\n2024-01-01;Tea, large;4,5\n",
    "tabs.csv": "date\tdescription\tamount\n2024-01-01\tTea\t4.5\n",
    "quoted.csv": 'date,description,amount\n2024-01-01,"Tea\n2 cups",4.5\n',
    "single.csv": "2024-01-05,Tea,4.50\n",
    "words.csv": "date,description,amount\nmonday,tea,free\n,,\n",
    "two.csv": "date,amount\n2024-01-01,4.5\n",
    "ragged.csv": "date,amount\n2024-01-01,4.5,extra,more\n",
}


def write(d, files=FILES):
    for name, text in files.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)


def test_each_strategy(spark, tmpdir_path):
    write(tmpdir_path)
    rows, verdicts = cascade.read_cascade(spark, tmpdir_path)
    got = {os.path.basename(r["source_file"]): r for r in verdicts.collect()}
    taken = {n: r["strategy"] for n, r in got.items()}
    assert taken == {"standard.csv": "standard", "semicolon.csv": "delimiter_detection", "tabs.csv": "delimiter_detection", "quoted.csv": "standard",
                     "single.csv": "corrupted_column", "words.csv": "manual_recovery", "two.csv": "manual_recovery", "ragged.csv": "unreadable"}
    assert [(t["strategy"], t["reason"]) for t in got["single.csv"]["tried"]] == [
        ("standard", "no record"), ("delimiter_detection", "no record"), ("corrupted_column", None)]
    assert [t["reason"] for t in got["two.csv"]["tried"]] == ["fewer than three columns", "no separator gives three columns", "fewer than three columns", "fewer than three columns", None]
    assert got["ragged.csv"]["tried"][0]["reason"] == "records wider than the header"
    cells = {}
    for r in rows.orderBy("source_file", "at").collect():
        cells.setdefault(os.path.basename(r["source_file"]), []).append(dict(zip(r["header"], r["cells"])))
    assert cells["standard.csv"] == [{"date": "2024-01-01", "description": "Tea", "amount": "4.5"}, {"date": "2024-01-02", "description": "Toast", "amount": None},
                                     {"date": None, "description": None, "amount": None}]
    assert cells["semicolon.csv"] == [{"date": "2024-01-01", "description": "Tea, large", "amount": "4,5"}]
    assert cells["quoted.csv"][0]["description"] == "Tea\n2 cups"
    assert cells["single.csv"] == [{"_c0": "2024-01-05", "_c1": "Tea", "_c2": "4.50"}]
    assert cells["words.csv"] == [{"date": "monday", "description": "tea", "amount": "free"}]   # the empty record goes
    assert cells["ragged.csv"] == [{"_c0": "date,amount"}, {"_c0": "2024-01-01,4.5,extra,more"}]
    assert cascade.without_empty(rows).filter("source_file LIKE '%standard.csv'").count() == 2


def test_types_and_samples_agree_with_pandas(spark, tmpdir_path):
    text = "i,f,b,s,gap,none,mixed\n1,1.5,True,x,3,,1\n-2,2,False,y,,,a\n30,1e3,True,z,4,,2\n4,.5,False,w,5,,3\n"
    write(tmpdir_path, {"a.csv": text})
    rows, _ = cascade.read_cascade(spark, tmpdir_path)
    got = {r["name"]: r for r in cascade.describe_columns(rows).collect()}
    want = pd.read_csv(io.StringIO(text))
    assert {n: r["dtype"] for n, r in got.items()} == {c: "object" if str(t) in ("object", "str", "string") else str(t) for c, t in want.dtypes.items()}
    raw = pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False)
    assert {n: [x or "" for x in r["samples"]] for n, r in got.items()} == {c: raw[c].head(3).tolist() for c in raw}
    assert got["gap"]["filled"] == 3 and got["gap"]["records"] == 4 and [r["position"] for r in sorted(got.values(), key=lambda r: r["position"])] == list(range(7))


def test_no_files(spark, tmpdir_path):
    write(tmpdir_path, {"blank.csv": "\n \n"})
    rows, verdicts = cascade.read_cascade(spark, tmpdir_path)
    assert rows.count() == 0 and verdicts.count() == 0 and cascade.describe_columns(rows).count() == 0

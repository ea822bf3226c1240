"""Duplicate files, and uploads as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.sinks import versions as V
from ledgerlake.sources import statements as SRC
from ledgerlake.streaming import ingest as XS

HEAD = "txn_id,account_id,date,description,amount,type,category\n"


def _drop(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_duplicate_files(spark, tmpdir_path):
    _drop(tmpdir_path, "a.csv", "date,amount\n1,2\n3,4\n")
    _drop(tmpdir_path, "b.csv", "date,amount\r\n1,2\r\n3,4\r\n")   # other line ends
    _drop(tmpdir_path, "c.csv", "date,amount\n1,2\n1,2\n3,4\n3,4\n")   # the same lines, another number
    _drop(tmpdir_path, "d.csv", "date,amount\n1,2\n")
    lines = SRC.read_lines(spark, tmpdir_path)
    got = {os.path.basename(r["source_file"]): (os.path.basename(r["keep_file"]), r["kept"]) for r in SRC.duplicate_files(lines).collect()}
    assert got == {"a.csv": ("a.csv", True), "b.csv": ("a.csv", False), "c.csv": ("c.csv", True), "d.csv": ("d.csv", True)}
    assert SRC.without_duplicate_files(lines, SRC.duplicate_files(lines)).count() == 3 + 5 + 2


def test_uploads_are_categorised_once(spark, tmpdir_path, monkeypatch):
    src, table = os.path.join(tmpdir_path, "drops"), os.path.join(tmpdir_path, "table")
    name = f"uploads-{os.path.basename(tmpdir_path)}"
    text = HEAD + '1,a,2024-01-15,Night taxi home,$4.50,Debit,\n2,a,Harbour Kiosk,2024-01-15,12.50,,\n3,a,,,,,\n4,a,2024-01-16,Kite club,3.00,Debit,Fees\n'
    _drop(src, "one.csv", text)
    run = lambda: XS.ingest_uploads(spark, src, table, "2024-06-30", name=name).awaitTermination()
    # the batch dies after it was saved and before the stream notes it
    real = V.replace
    def dies(*a, **k):
        real(*a, **k)
        raise RuntimeError("lost")
    monkeypatch.setattr(V, "replace", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(V, "replace", real)
    run()
    got = {r["txn_id"]: r for r in V.read(spark, table).collect()}
    assert V.read(spark, table).count() == 3 and set(got) == {1, 2, 4}
    assert got[1]["how"] == "parsed" and got[2]["how"] == "fuzzy_column_matching" and got[4]["category"] == "fees" and got[1]["category"]
    assert [r["txn_id"] for r in spark.read.parquet(table + "_quarantine").collect()] == [3]
    _drop(src, "copy of one.csv", text)   # another name, a later batch
    _drop(src, "two.csv", HEAD + "9,b,2024-02-01,Soup,7.00,Debit,food\n")
    run()
    run()
    assert sorted(r["txn_id"] for r in V.read(spark, table).collect()) == [1, 2, 4, 9]
    assert V.read(spark, table).filter(F.col("account_id") == "b").first()["amount"] == -7.0

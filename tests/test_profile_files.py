"""File profiling (S3–S6, S8, S11, S13, S14) on hand-made statement files."""

import hashlib
import os

from ledgerlake.sources import statements as SRC


def _write(d, name, data: bytes):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_profile_files(spark, tmpdir_path):
    d = tmpdir_path
    comma = b"Date,Description,Amount\n2024-01-15,Tea Room,4.50\n2024-01-16,Lunch,12.00\n"
    semi = "Date;Description;Amount\n15/01/2024;Café;4,50\n".encode("utf-8")
    latin = "Date;Description;Amount\n15/01/2024;Caf\xe9;4,50\n".encode("latin-1")
    bom = b"\xef\xbb\xbf" + comma
    shifted = b"Date,Description,Amount\n1,2,3,4\n"
    _write(d, "comma.csv", comma)
    _write(d, "semi.csv", semi)
    _write(d, "latin.csv", latin)
    _write(d, "bom.csv", bom)
    _write(d, "shifted.csv", shifted)
    _write(d, "empty.csv", b"")
    _write(d, "notes.txt", comma)
    prof = {os.path.basename(r.path): r for r in
            SRC.profile_files(SRC.read_files(spark, d, glob="*")).collect()}
    assert prof["comma.csv"].delimiter == "," and prof["comma.csv"].strategy == "standard"
    assert prof["comma.csv"].has_header and prof["comma.csv"].column_count == 3
    assert prof["comma.csv"].sample_rows == 2 and prof["comma.csv"].valid
    assert prof["comma.csv"].file_hash == hashlib.sha256(comma).hexdigest()
    assert prof["semi.csv"].delimiter == ";" and prof["semi.csv"].strategy == "delimiter_detection"
    assert prof["semi.csv"].encoding == "utf-8"
    assert prof["latin.csv"].encoding == "windows-1252" and prof["latin.csv"].delimiter == ";"
    assert prof["bom.csv"].encoding == "utf-8-sig"
    assert list(prof["comma.csv"].likely_delimiters) == [",", ";", "\t", "|"]
    assert "Line 2: Pattern '\\d+,\\d+,\\d+' detected" in prof["shifted.csv"].corruption_indicators
    assert any(x.startswith("Inconsistent column counts") for x in prof["shifted.csv"].corruption_indicators)
    # Spark's file listing skips zero-length files, so an empty upload never reaches the
    # profile (it cannot be reported as invalid through binaryFile)
    assert "empty.csv" not in prof
    assert not prof["notes.txt"].valid and prof["notes.txt"].invalid_reason == "unsupported file type"
    # profile-routed read: both delimiters come back with their own scan
    got = SRC.read_by_profile(spark, SRC.profile_files(SRC.read_files(spark, d)))
    rows = {(r["Description"], r["parse_strategy"]) for r in got.collect()}
    assert ("Tea Room", "standard") in rows and ("Café", "delimiter_detection") in rows


def test_records_are_read_whole_by_their_own_header(spark, tmpdir_path):
    """Two column orders, a row wider than any cap, extra cells, quoted line ends, old encodings."""
    d = tmpdir_path
    wide = ["w%d" % i for i in range(80)]
    _write(d, "a.csv", b"date,description,amount\n2024-01-01,Tea,4.5\n2024-01-02,Toast,5,EXTRA,MORE\n")
    _write(d, "b.csv", b"amount,category,date,description\n9.99,Food,2024-01-03,Soup\n")
    _write(d, "c.csv", b'date;description;amount\n2024-01-04;"Cake, large\nwith ""note""";7\n2024-01-05;Pie;8\n')
    _write(d, "e.csv", "Posted_Date;Merchant;Sum\n2024-01-06;Caf\xe9 \u20ac;3\n".encode("cp1252"))
    _write(d, "w.csv", (",".join("h%d" % i for i in range(80)) + "\n" + ",".join(wide) + "\n").encode())
    rows = SRC.read_records(spark, d).collect()
    by = {(os.path.basename(r["source_file"]), r["fields"].get("description") or r["fields"].get("Merchant")): r for r in rows}
    assert by["a.csv", "Tea"]["fields"]["amount"] == "4.5" and by["a.csv", "Tea"]["_corrupt_record"] is None
    assert by["a.csv", "Toast"]["extra"] == ["EXTRA", "MORE"] and by["a.csv", "Toast"]["_corrupt_record"].endswith("EXTRA,MORE")
    assert by["b.csv", "Soup"]["fields"] == {"amount": "9.99", "category": "Food", "date": "2024-01-03", "description": "Soup"}
    assert by["c.csv", 'Cake, large\nwith "note"']["fields"]["amount"] == "7" and by["c.csv", "Pie"]["fields"]["amount"] == "8"
    assert by["e.csv", "Caf\xe9 \u20ac"]["fields"]["Sum"] == "3"
    assert by["w.csv", None]["cells"] == wide and len(rows) == 7
    canon = SRC.statement_columns(SRC.read_records(spark, d), {"date": ["date"], "description": ["description", "merchant"], "amount": ["amount", "sum"]})
    got = {(r["date"], r["amount"]) for r in canon.collect()}
    assert {("2024-01-01", "4.5"), ("2024-01-03", "9.99"), ("2024-01-06", "3")} <= got
    # the grouped CSV scans give each file its own header too, and a size limit only reports
    prof = SRC.profile_files(SRC.read_files(spark, d), max_bytes=10)
    assert not any(r["valid"] for r in prof.collect())
    swapped = {r["description"]: (r["amount"], r["date"]) for r in SRC.read_by_profile(spark, prof.filter("path LIKE '%a.csv' OR path LIKE '%b.csv'")).collect()}
    assert swapped["Soup"] == ("9.99", "2024-01-03") and swapped["Tea"] == ("4.5", "2024-01-01")
    assert SRC.read_by_profile(spark, prof.limit(0)).count() == 0


def test_a_file_over_16_mb_is_read_whole_in_splits(spark, tmpdir_path):
    line = b"2024-01-01,A rather long description of a purchase,4.50\n"
    n = 18 * 1024 * 1024 // len(line)
    _write(tmpdir_path, "big.csv", b"date,description,amount\n" + line * n)
    assert spark.read.option("pathGlobFilter", "*.csv").text(tmpdir_path).rdd.getNumPartitions() > 1
    assert SRC.read_records(spark, tmpdir_path).filter("fields['amount'] = '4.50'").count() == n

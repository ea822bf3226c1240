"""ledgerlake — bank-statement analytics as Spark DataFrame operators.

Sub-packages:
  sources    readers: statement CSV/text/binary scans, the test-table adapter, stored tables
  sinks      writers: CSV export, replace-by-hash, upserts, retention
  functions  column expressions: dates, amounts, currency detection, formatting, text
  operators  DataFrame -> DataFrame operators: cleaning, validation, recovery, categorising,
             currency conversion, spending aggregates, budgets, top-k
  plans      end-to-end compositions (upload flow, normalise-and-convert flow, analysis bundle)
  streaming  Structured Streaming ingest and running aggregates
"""

__version__ = "0.1.0"

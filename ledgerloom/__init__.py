"""Ledgerloom: document-to-ledger processing expressed as Spark DataFrames."""

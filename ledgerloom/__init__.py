"""A balance-event ledger engine on Spark DataFrames."""

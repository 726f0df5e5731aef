"""Statement-ledger analytics on Spark: operators are DataFrame -> DataFrame functions."""

"""ledgerline: data contracts, profiling, validation and lineage on Spark DataFrames."""

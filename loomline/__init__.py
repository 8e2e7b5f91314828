"""Loomline: text-corpus and job-ledger analytics on Spark DataFrames."""

"""A reconciliation engine on Spark DataFrames: two record sets in, matched, classified and audited rows out."""

"""Table lineage, SQL-corpus rollup, change comparison and bounded histories on Spark DataFrames."""

"""German document analytics on Spark: columns, table operators and plans over corpora."""

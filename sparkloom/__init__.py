"""sparkloom: feature engineering, classical models and data profiling on Spark DataFrames."""

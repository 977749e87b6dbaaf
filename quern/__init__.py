"""Analytics over retrieval corpora and inference telemetry, on Spark DataFrames."""

"""tidemark: market-data and event time-series analytics as Spark DataFrame transformations."""

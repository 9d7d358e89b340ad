"""A time-series analytics engine on Spark, and operators for training corpora."""

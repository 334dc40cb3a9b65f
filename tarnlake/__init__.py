"""Spark-first analytics for recorded behaviour, aligned time series and text corpora."""

"""Environmental time-series analytics expressed as PySpark DataFrame jobs."""

"""Network data quality on Spark."""

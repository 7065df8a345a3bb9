"""Time-series analytics and forecasting over many series, written as Spark DataFrame jobs."""

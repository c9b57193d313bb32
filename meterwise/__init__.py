"""meterwise: usage metering, rating and cost analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"

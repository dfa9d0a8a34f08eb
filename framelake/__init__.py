"""framelake: Spark DataFrame and Structured Streaming operators for CAN capture data."""

__version__ = "0.1.0"

"""Table profiling and statement reconstruction as PySpark jobs."""

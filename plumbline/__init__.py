"""Dataset profiling, claim audit and lakehouse reporting as Spark jobs."""

"""kvlake: multi-version key-value analytics as Spark DataFrame jobs."""

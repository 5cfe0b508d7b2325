"""loomrank: learning-to-rank analytics as PySpark DataFrame pipelines."""

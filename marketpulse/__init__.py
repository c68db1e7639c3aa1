"""Market-sentiment analytics as PySpark DataFrame operators."""

"""Case and product-catalog analytics as PySpark DataFrame jobs."""

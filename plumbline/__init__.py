"""Price-transparency analytics on Spark."""

"""Population-genetics analytics on Spark."""

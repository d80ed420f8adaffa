"""Point-in-time table research on Spark."""

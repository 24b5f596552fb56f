"""Document privacy analytics and corpus preparation on Spark."""

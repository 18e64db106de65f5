"""Results analytics for competitions on Spark."""

"""novelspark: exploring large embedded archives by novelty, as Spark jobs."""

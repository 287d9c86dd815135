"""Article collection and curation as Spark DataFrame jobs."""

"""Question/answer corpus preparation and answer scoring as Spark DataFrame jobs."""

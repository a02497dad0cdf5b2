"""leadweave: lead-prospecting analytics as Spark DataFrame jobs."""

"""Formula and concept graph analytics as Spark jobs."""

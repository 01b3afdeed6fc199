"""Binary risk scoring, drift and data checks as Spark jobs."""

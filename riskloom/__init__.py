"""Source-risk analytics on Spark."""

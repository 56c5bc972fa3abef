"""matchspark: job-market analytics as Spark batch and streaming operators."""

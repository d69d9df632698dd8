"""Dataset evidence on Spark: profiles, version diffs, diagnosis, variants."""

"""Score-prediction analytics on Spark: set-based operators over users, groups and games."""

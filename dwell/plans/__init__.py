"""End-to-end plans: feature datasets, audit report, training runs and the query registry."""

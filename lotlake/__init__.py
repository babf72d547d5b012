"""Spark jobs over auction-lot pages: extraction, dedup, change-data merge, reports and models."""
